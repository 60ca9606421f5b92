"""Personal data and secrets against plain expressions on made texts."""

import os
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarterline.llm import pii, secret_scan
from quarterline.llm.secret_scan import BASE_RULES, MORE_RULES, Rule, scan_shard, trigram_query

PLAIN_PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_pii(text):
    out = []
    for kind, p in PLAIN_PII.items():
        for m in re.finditer(p, text):
            d = re.sub(r"[^0-9]", "", m[0])
            ok = {
                "email": True,
                "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                "card": 12 <= len(d) <= 19 and pii.luhn(d),
                "phone": 9 <= len(d) <= 15,
            }[kind]
            if ok:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], list(PLAIN_PII).index(s[2])))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a1 .@-+()2560é%", max_size=60))
def test_base_pii_is_the_plain_expressions(text):
    assert pii.base_spans(text) == plain_pii(text)


@pytest.mark.parametrize("text", ["a@b.co_x@y.zz", "x@@b.c@d.e.f@g.h", "4111 1111 1111 1111 and 4111111111111112",
                                  "1.2.3.4.5.6.7.8 999.1.1.1", "+1 (407) 555-7710, +12"])
def test_base_pii_cases(text):
    assert pii.base_spans(text) == plain_pii(text)


@pytest.mark.parametrize("unit", ["a.", "1", "1.", "a@", "+1", "1 ", "at) "])
def test_pii_is_linear_in_long_texts(unit):
    pii.classified(unit * 60_000, {"weights": {}, "bias": -1.0})


PLAIN_SECRET = {
    "assign": (r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]+", 0, 32),
}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["token", "Api_KEY", "apikey", "pass", "word", "=", ":", " ", '"', "AKIA", "A1B2C3D4E5F6", "deadbeef", "0123456789abcdef", "ſecret", "é", "\n", "g"]), max_size=14))
def test_base_secrets_are_the_plain_expressions(parts):
    text = "".join(parts)
    expected = [(m.start(), m.end(), k) for k, (p, g, n) in PLAIN_SECRET.items() for m in re.finditer(p, text) if len(m[g]) >= n]
    assert scan_shard([text, "", "other"], BASE_RULES)[0] == expected


def test_queries():
    assert trigram_query(r"[0-9a-f]{32,}") is None
    assert trigram_query(r"AKIA[A-Z0-9]+") == ("and", frozenset([b"aki", b"kia"]))
    assert trigram_query(r"(ab|c)d") is None
    q = trigram_query(BASE_RULES[0].pattern, BASE_RULES[0].flags)
    assert q[0] == "or" and b"tok" in secret_scan.trigrams_of(q)
    assert trigram_query(r"foo(x+)?bar") is not None


def test_a_rule_without_trigrams_scans_everything():
    assert scan_shard(["zz9", "q"], [Rule("d", r"[0-9]")])[0] == [(2, 3, "d")]


def test_secret_operator(spark):
    rows = [(1, "token = 'abcdefgh12' ghp_" + "Z" * 36, 5), (1, None, 5), (None, "", 6), (2, "x" * 200_000, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, N_ASSIGN int")
    out, s = secret_scan.find_secrets(docs)
    got = {(r.doc_id, r.text): r[s] for r in out.collect()}
    assert len(got) == 4 and got[(1, rows[0][1])].spans == "assign:0:19,github:21:61"
    assert got[(1, None)].spans == "" and got[(None, "")].n_assign == 0
    assert secret_scan.find_secrets(docs.limit(0))[0].count() == 0


def test_pii_operator(spark):
    rows = [(i, f"call me at (407) 555-77{i:02d} or mail a{i}@b.org and 10.0.0.{i}", "x", "s", 1) for i in range(30)]
    rows += [(50, None, None, None, None), (None, "", "x", None, 3), (51, "plain words 2020-01-02", "x", "s", 1)]
    rows += [(60 + i, f"plain words 2020-01-{i}", "x", "s", 1) for i in range(10, 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, PII string, n_chars long")
    model = pii.train(docs)
    assert 0 < model["reliability"]["pattern"] <= 1
    out, p = pii.find_pii(docs, model)
    got = {r.doc_id: r[p] for r in out.collect()}
    assert got[3].n_email == 1 and got[3].n_ip == 1 and got[3].n_number == 1
    assert got[50].spans == "" and got[51].spans == ""
    masked = {r.doc_id: r for r in pii.redact(docs, model).collect()}
    assert masked[3].text == "call me at [NUMBER] or mail [EMAIL] and [IP]" and masked[3].n_chars == len(masked[3].text)
    assert masked[50].text is None and pii.redact(docs, model).columns == docs.columns
    assert pii.find_pii(docs.limit(0))[0].count() == 0


def iban(body):
    check = 98 - int("".join(str(int(c, 36)) for c in body + "DE00")) % 97
    return f"DE{check:02d}{body}"


def planted(seed, n):
    """Texts with the spans that are personal, of every added kind, among lookalikes."""
    import random

    rng = random.Random(seed)
    given, family = sorted(pii.GIVEN), ["Novak", "Lindqvist", "Okafor", "Moreau", "Becker"]
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    yes = [
        ("number", lambda: ("please call ", f"({digits(3)}) {digits(3)}-{digits(4)}")),
        ("number", lambda: ("reach us under ", f"{digits(3)}-{digits(3)}-{digits(4)}")),
        ("person", lambda: ("the report was read by ", f"{rng.choice(['Mr', 'Dr.', 'Frau'])} {rng.choice(family)}")),
        ("person", lambda: ("regards, ", f"{rng.choice(given)} {rng.choice(family)}")),
        ("person", lambda: ("it was told to ", f"{rng.choice(given)} {rng.choice(family)}")),
        ("account", lambda: ("transfer to ", iban(digits(18)))),
        ("address", lambda: ("write to ", f"{rng.choice('abcdef')}{digits(2)} (at) mail (dot) org")),
    ]
    no = [
        lambda: f"on {digits(4)}-0{digits(1)}-1{digits(1)}", lambda: f"order {digits(9)}", lambda: f"{digits(8)} km",
        lambda: f"from 20{digits(2)}-20{digits(2)}", lambda: f"code DE00{digits(18)}", lambda: f"{rng.choice(given)} Lane Street",
        lambda: f"host 9{digits(2)}.999.1.1", lambda: f"number 7{digits(15)}1x", lambda: "Yesterday Morning", lambda: f"id {digits(7)}",
    ]
    for _ in range(n):
        text, truth = "a few words first", set()
        for _ in range(4):
            if rng.random() < 0.5:
                kind, make = rng.choice(yes)
                before, span = make()
                text += ", " + before
                truth.add((len(text), len(text) + len(span), kind))
                text += span + " and more words"
            else:
                text += ", " + rng.choice(no)() + " and more words"
        text += f", mail x{digits(3)}@host.org or 10.0.{int(digits(2))}.7"
        yield text, truth


def test_added_spans_of_planted_texts():
    from collections import Counter

    counts = Counter(x for text, _ in planted(1, 600) for x in pii.described(text))
    model = pii.fit(list(counts.items()))
    assert min(model["reliability"].values()) > 0.5
    found, truth, both = Counter(), Counter(), Counter()
    for text, spans in planted(2, 400):
        base, all_ = pii.classified(text, model)
        added = set(all_) - set(base)
        assert set(base) <= set(all_) and base == plain_pii(text)
        found.update(k for *_, k in added)
        truth.update(k for *_, k in spans)
        both.update(k for *_, k in added & spans)
    assert sum(both.values()) >= 0.95 * sum(found.values()), (found, truth, both)
    assert all(both[k] >= 0.9 * truth[k] for k in pii.MORE_KINDS), (found, truth, both)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no driver tables")
def test_no_labeler_turns_round_on_the_tables(spark):
    model = pii.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    assert list(model["reliability"]) == pii.LABELERS and min(model["reliability"].values()) > 0.5


def test_known_classes_anchor_the_model():
    import numpy as np

    # one labeler votes on each row; the known rows say which side is which
    votes = np.array([[1, 0], [1, 0], [0, -1], [0, -1], [0, 0]])
    p, right = pii.estimate(votes, np.array([50.0, 50, 50, 50, 9]), np.array([0, 1, 0, 1, 1]), np.array([1, -1, 0, -1, -1]))
    assert p[1] > 0.8 > 0.2 > p[3] and right.min() > 0.8
    wrong = np.array([[1, 0], [-1, 1]])  # a labeler that contradicts what is known stays at the bound
    assert pii.estimate(wrong, np.array([90.0, 90]), np.zeros(2, int), np.array([0, 1]))[1][0] == pii.WORST


def test_em_recovers_reliabilities():
    import numpy as np

    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.4
    right = [0.95, 0.8, 0.7]
    votes = np.stack([np.where(rng.random(4000) < a, truth, ~truth) * 2 - 1 for a in right], 1)
    p, reliability = pii.estimate(votes, np.ones(4000), np.zeros(4000, int))
    assert np.abs(reliability - right).max() < 0.06 and ((p > 0.5) == truth).mean() > 0.9


@pytest.mark.parametrize("pattern, flags, text", [
    ("CAFÉ-[0-9]+", re.ASCII, "see CAFÉ-123 here"),
    ("CAFÉ-[0-9]+", 0, "see CAFÉ-123 here"),
    ("café-[0-9]+", re.IGNORECASE, "see CAFÉ-123 here"),
    ("task-[0-9]+", re.IGNORECASE, "see taſ\u212a-123 here"),
    ("x(?i:straße)y", 0, "xSTRAẞEy"),
    ("[ÀÉ]bc-[0-9]", 0, "Ébc-1"),
    ("AKIA[ÄÖ]x", re.IGNORECASE | re.ASCII, "akiaÄX"),
])
def test_rules_with_letters_beyond_ascii(pattern, flags, text):
    rule = Rule("r", pattern, 0, 0, flags)
    want = [(m.start(), m.end(), "r") for m in re.finditer(pattern, text, flags)]
    assert want and scan_shard(["nothing", text], [rule]) == [[], want]
