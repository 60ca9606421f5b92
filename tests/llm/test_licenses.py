"""Licence scans: automaton, matching statistics and chains against brute force, and planted licences."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarterline.llm import licenses as li


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


SMALL = [("x", "a b a c a b a d b", 0.5), ("y", "b a b a c d d d", 0.5), ("z", "d a b a", 1.0)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcde"), max_size=30), st.integers(1, 9))
def test_matching_statistics_are_brute_force(text, piece):
    a = li.build(SMALL, {"b a": "p", "d": "q", "a b a c": "r"})
    runs = [words(t) for _, t, _ in SMALL] + [["b", "a"], ["d"], ["a", "b", "a", "c"]]
    inside = lambda x: any(r[i : i + len(x)] == x for r in runs for i in range(len(r)))
    want = []
    for end in range(len(text)):
        k = max((k for k in range(1, end + 2) if inside(text[end - k + 1 : end + 1])), default=0)
        if k:
            want.append((end, k))
    raw = " ".join(text).encode()
    got = list(li.statistics(a, raw, piece))
    assert [(n, k) for n, s, k in got[:-1]] == want and got[-1] == (len(text), 0, 0)
    phrases = [(p, i) for p, q in enumerate((["b", "a"], ["d"], ["a", "b", "a", "c"])) for i in range(len(text)) if text[i : i + len(q)] == q]
    assert sorted(li.scan(a, raw, piece).phrases) == sorted(phrases)


def test_places_of_a_state_are_all_ends():
    a = li.default_automaton()
    texts = [words(t) for t in [*li.TEMPLATES.values(), *li.GRANTS]]
    by_word = {n: w.decode() for w, n in a.vocabulary.items()}
    rng = random.Random(1)
    for t in rng.sample(range(len(texts)), 12):
        at = rng.randrange(0, len(texts[t]) - li.LEAST + 1)
        run = texts[t][at : at + rng.randrange(li.LEAST, 9)]
        s = 0
        for w in run:
            s = a.next[s][a.vocabulary[w.encode()]]
        want = sorted((u, i + len(run) - 1) for u, x in enumerate(texts) for i in range(len(x)) if x[i : i + len(run)] == run)
        assert sorted(a.places[s]) == want and by_word


def brute_chain(boxes):
    best = 0
    for mask in range(1 << len(boxes)):
        part = sorted(b for i, b in enumerate(boxes) if mask >> i & 1)
        if all(p[0] + p[2] <= q[0] and p[1] + p[2] <= q[1] for p, q in zip(part, part[1:])):
            best = max(best, sum(b[2] for b in part))
    return best


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 10), st.integers(1, 5)), max_size=9))
def test_chain_is_brute_force(boxes):
    covered, first, last = li.best_chain(boxes, 20)
    assert covered == brute_chain(boxes)
    if boxes:
        assert any(b[0] == first for b in boxes) and any(b[0] + b[2] - 1 == last for b in boxes)


def noise(rng, n):
    return " ".join(rng.choice(["the", "software", "of", "any", "blue", "Étoile", "x1", "license", "by"]) for _ in range(n))


@pytest.mark.parametrize("name", list(li.TEMPLATES))
def test_planted_licences_are_found_with_edits(name):
    rng = random.Random(name)
    a = li.default_automaton()
    whole = li.TEMPLATES[name].split()
    edited = list(whole)
    for i in range(8, len(edited), 23):
        edited[i] = "zzz"
    for body in (whole, edited):
        text = f"{noise(rng, 300)}\n# {' '.join(body).upper()}\n{noise(rng, 300)}"
        found = li.scan(a, text.encode())
        span = next(s for s in found.spans if s[0] == name)
        assert span[1] >= 290 and span[2] <= 310 + len(words(" ".join(body))) and span[3] > 0.6
        assert found.n_words == len(words(text))
    half = " ".join(whole[: len(whole) // 3])
    assert name not in [s[0] for s in li.scan(a, half.encode()).spans]


def test_shuffled_and_plain_words_give_no_label():
    rng = random.Random(2)
    a = li.default_automaton()
    for name, t in li.TEMPLATES.items():
        w = t.split()
        rng.shuffle(w)
        assert name not in [s[0] for s in li.scan(a, " ".join(w).encode()).spans]
    assert li.scan(a, noise(rng, 5000).encode()).spans == []


def test_two_copies_far_apart_are_two_spans_and_long_texts_are_linear():
    a = li.default_automaton()
    text = li.TEMPLATES["isc"] + " w" * 200 + " " + li.TEMPLATES["isc"]
    assert [s[0] for s in li.scan(a, text.encode()).spans] == ["isc", "isc"]
    many = li.scan(a, ((li.TEMPLATES["mit"] + " and ") * 2000).encode())
    assert {s[0] for s in many.spans} == {"mit"} and many.best == 1.0


def test_operator_over_nulls_and_clashing_columns(spark):
    texts = [None, "", " \n", "MIT License.", "mit-license (MIT\tLicense) and cc by", "Licensed under CC BY-NC 4.0.", "gnu general public",
             "Licensed under the GNU General Public License, version 3.", "MIT LICENSE " * 3, "İ mit license", li.TEMPLATES["zlib"]]
    docs = spark.createDataFrame([(i, t, "a", "b") for i, t in enumerate(texts)] + [(None, "MIT License.", "a", "b")] * 2, "doc_id bigint, text string, __licenses string, SCORE string")
    found, s = li.scan_licenses(docs)
    assert s != "__licenses" and found.columns[:4] == docs.columns
    rows = {r.doc_id: r[s] for r in found.collect()}
    assert found.count() == len(texts) + 2
    plain = {p: re.compile(r"(?<![^\x00-\x2F\x3A-\x60\x7B-\x7F])" + r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+".join(p.split()) + r"(?![^\x00-\x2F\x3A-\x60\x7B-\x7F])") for p in li.PHRASES}
    for i, t in enumerate(texts):
        w = words(t or "")
        starts = {p: [k for k in range(len(w)) if w[k : k + len(p.split())] == p.split()] for p in li.PHRASES}
        every = sorted(x for v in starts.values() for x in v)
        r = rows[i]
        assert (r.n_words, r.n_base) == (len(w), len(every)), t
        assert (r.first_word, r.last_word) == ((every[0], every[-1]) if every else (None, None))
        assert r.base_labels == ",".join(sorted({li.PHRASES[p] for p, v in starts.items() if v}))
        assert 0 <= r.score <= 1 and set(r.base_labels.split(",")) <= {"", *r["labels"].split(",")}
        assert sum(len(p.findall((t or "").lower())) for p in plain.values()) <= len(every)
    assert rows[5]["labels"] == "cc-by,cc-by-nc-4.0" and rows[7]["labels"] == "gpl,gpl-3.0" and rows[10]["labels"] == "zlib"
    assert rows[0].score == 0 and rows[3].score == li.PHRASE_SCORE and rows[5].score == 1
    assert li.scan_licenses(docs.limit(0))[0].count() == 0
