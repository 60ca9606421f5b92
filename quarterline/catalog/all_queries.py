"""Import every catalogue module so that its queries register."""

from quarterline.catalog import ingest  # noqa: F401
from quarterline.catalog import text  # noqa: F401
from quarterline.catalog import lexicon, tone  # noqa: F401
from quarterline.catalog import corpus, events, series  # noqa: F401
from quarterline.catalog import regress, weak  # noqa: F401
from quarterline.catalog import cjk  # noqa: F401
from quarterline.catalog import long  # noqa: F401
from quarterline.catalog import learned  # noqa: F401
from quarterline.catalog import storage  # noqa: F401
