"""Import every operator module so that its query registers."""

from quarterline.llm import (  # noqa: F401
    centroids,
    decontaminate,
    html_extract,
    licenses,
    lm,
    mixture,
    ngram_join,
    pii,
    prefix_trie,
    quality,
    secret_scan,
    toxicity,
    warc,
)
from quarterline.llm.common import ORACLES, QUERIES  # noqa: F401
