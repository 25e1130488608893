"""Base spans against plain regular expressions, and what the methods add."""

import hashlib
import math
import random
import re

import pandas as pd
import pytest

from pointweave.llm import pii, secrets

ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute_secrets(t):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    return [(s, e, k) for s, k, e in sorted(out)]


def luhn(d):
    x = [int(c) for c in d[::-1]]
    return (sum(x[::2]) + sum(sum(divmod(2 * c, 10)) for c in x[1::2])) % 10 == 0


def brute_pii(t):
    only = lambda s: re.sub(r"[^0-9]", "", s)
    out = [(m.start(), m.end(), 0) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), m.end(), 1) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), m.end(), 2) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(only(m[0])) <= 19 and luhn(only(m[0]))]
    out += [(m.start(), m.end(), 3) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(only(m[0])) <= 15]
    return out


PIECES = ["a", "b@c.d", "@", ".", "x", "1", "255.", "3", "4.", "+1 (", ") 555-", "4111 1111 1111 1111", "4111-1111-1111-1111", " ", "é", "-", "Token", "PASSWD", "api_key", "=", ": ", '"', "'", "abcdef0123456789", "AKIA", "ABCD1234", "ſecret", "\n", "00", "+", "_"]


def test_base_spans_match_plain_patterns():
    rng = random.Random(7)
    for _ in range(30000):
        t = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(t) == brute_pii(t), t
        assert secrets.base_spans(t) == brute_secrets(t), t


@pytest.fixture(scope="module")
def docs(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    return df, {r["doc_id"]: r["text"] for r in df.collect()}


def digest(spans, kinds):
    return hashlib.sha256(",".join(f"{kinds[k]}:{s}:{e}" for s, e, k in spans).encode()).hexdigest()


@pytest.mark.parametrize(("query", "brute", "kinds"), [(pii.op2_pii, brute_pii, pii.KINDS), (secrets.op8_secrets, brute_secrets, secrets.KINDS)])
def test_queries_keep_base_spans_of_whole_texts(spark, sf, docs, query, brute, kinds):
    rows = query(spark, sf).collect()
    assert len(rows) == len(docs[1])
    for r in rows:
        base = brute(docs[1][r["doc_id"]] or "")
        assert r["base_sha256"] == digest(base, kinds)
        every = [tuple(x.split(":")) for x in r["spans"].split(",")] if r["spans"] else []
        assert {(k, int(s), int(e)) for k, s, e in every} >= {(kinds[k], s, e) for s, e, k in base}


def frame(spark, texts):
    return spark.createDataFrame(pd.DataFrame({"doc_id": range(len(texts)), "text": texts, "spans": 1, "base": 2}), "doc_id long, text string, spans int, base int")


def test_randomness_battery(spark):
    rng = random.Random(3)
    al = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    keys = ["".join(rng.choice(al) for _ in range(40)) for _ in range(20)]
    words = ["Internationalization-and-Localization2024", "the/path/of/some/File/in/a/tree/Version2", "zzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzZZZZZZZZ1", "12345678901234567890123"]
    texts = [f"x {k} y" for k in keys] + [f"x {w} y" for w in words] + ["", None, "x " * 50000]
    got = {r["doc_id"]: r["spans"] for r in secrets.detect(frame(spark, texts)).collect()}
    hit = [i for i in range(20) if [s["kind"] for s in got[i]] == [3]]
    assert len(hit) >= 18
    assert all(not got[i] for i in range(20, len(texts)))
    assert secrets.redact(texts[hit[0]], [tuple(s) for s in got[hit[0]]]) == "x [SECRET] y"


BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def test_long_keys_are_found_and_redacted(spark):
    rng = random.Random(5)
    lengths = [20, 40, 100, 300, 500, 600, 700, 900, 2000, 20000, 100000]
    texts = [f"x {''.join(rng.choice(BASE64) for _ in range(n))} y" for n in lengths] + ["plain words"]
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in secrets.detect(frame(spark, texts)).collect()}
    assert [got[i] for i in range(1, len(lengths))] == [[(2, 2 + n, 3)] for n in lengths[1:]] and not got[len(lengths)]
    clean = {r["doc_id"]: r["text"] for r in secrets.redacted(frame(spark, texts)).collect()}
    assert all(clean[i] == "x [SECRET] y" for i in range(1, len(lengths))) and clean[len(lengths)] == "plain words"


def test_random_spans_are_those_of_plain_benjamini_hochberg(spark, docs):
    """The same p-values, sorted and cut class by class in plain code."""
    rng = random.Random(6)
    extra = {-i - 1: f"k {''.join(rng.choice(BASE64[: rng.choice([36, 62, 64])]) for _ in range(rng.randint(20, 70)))} and Version{i}0115ReleaseBuild{i * 37}" for i in range(400)}
    texts = {**docs[1], **extra}
    found = []
    for i, t in texts.items():
        base = brute_secrets(t or "")
        for m in re.finditer(r"[A-Za-z0-9+/_-]{20,}={0,2}", t or ""):
            name = secrets.infer(m[0])
            if name and not any(s < m.end() and m.start() < e for s, e, _ in base):
                level = secrets.battery(m[0], name)
                found.append((i, m.start(), m.end(), min(6, (m.end() - m.start()).bit_length()), min(59.9, int(level * 10) / 10)))
    want = set()
    for size in {f[3] for f in found}:
        own = sorted((f for f in found if f[3] == size), key=lambda f: -f[4])
        good = [f[4] for k, f in enumerate(own) if 10 ** -f[4] <= secrets.FDR * (k + 1) / len(own)]
        want |= {f[:3] for f in own if good and f[4] >= min(good)}
    df = spark.createDataFrame(pd.DataFrame({"doc_id": texts.keys(), "text": texts.values()}))
    got = {(r["doc_id"], s["start"], s["end"]) for r in secrets.detect(df).collect() for s in r["spans"] if s["kind"] == 3}
    assert got == want and len(want) > 200 and len(want) < len(found)


def test_disclosing_terms(spark):
    filler = [f"plain words number{i} about gardens and weather today" for i in range(60)]
    leak = [f"{a} zorblatt wrote {b} to kim@example.org for {c} help" for a, b, c in zip("alpha beta gamma delta omega".split(), "letters papers essays notes cards".split(), "some more extra quick kind".split(), strict=True)]
    texts = [*filler, *leak, "zorblatt was seen again", "", None, None]
    got = {r["doc_id"]: r["spans"] for r in pii.detect(frame(spark, texts)).collect()}
    assert [s["kind"] for s in got[60]] == [0, 4] or 4 in [s["kind"] for s in got[60]]
    lone = got[65]
    assert [texts[65][s["start"] : s["end"]] for s in lone] == ["zorblatt"]
    assert all(not got[i] for i in range(60)) and not got[66] and not got[67]
    assert pii.sanitise(texts[65], [tuple(s) for s in lone]) == "[TERM] was seen again"


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pii.detect(empty).count() == 0
    assert secrets.detect(empty).count() == 0


def test_terms_of_all_passes_are_marked(spark, monkeypatch):
    names = ["".join(chr(97 + int(d)) * 2 for d in f"{i:03d}") for i in range(108)]
    texts = [f"{a} {n} {b} kim{i}@example.org" for i, n in enumerate(names) for a, b in (("some", "with"), ("more", "from"), ("that", "this"))]
    want = {r["doc_id"]: r["spans"] for r in pii.detect(frame(spark, texts)).collect()}
    n_terms = pii.disclosing(frame(spark, texts)).count()
    assert n_terms >= 100
    for bound in (int(n_terms / 0.9), n_terms // 3):
        monkeypatch.setattr(pii, "TERMS_A_PASS", bound)
        assert {r["doc_id"]: r["spans"] for r in pii.detect(frame(spark, texts)).collect()} == want


def brute_terms(texts):
    """(term spans by text, removed terms): the definitions, word by word, in plain code."""
    word = re.compile(r"[^\x20\x09-\x0D]+")
    near_of, near_any, contexts, total, positions = {}, {}, {}, {}, 0
    for i, t in texts.items():
        words = [m.span() for m in word.finditer(t or "")]
        positions += len(words)
        whole = [pii.terms(t[a:b]) for a, b in words]
        for term in whole:
            if term:
                total[term] = total.get(term, 0) + 1
        spans = brute_pii(t or "")
        for s, e, k in spans:
            near = []
            cut = [(a, min(b, s)) for a, b in words if a < s][-pii.NEAR :] + [(max(a, e), b) for a, b in words if b > e][: pii.NEAR]
            for a, b in cut:
                n = next(n for n, (x, y) in enumerate(words) if x <= a and b <= y)
                near.append((n, pii.terms(t[a:b])))
            key = ",".join(sorted({x for _, x in near if x}))
            for entity in (pii.value(t, (s, e, k)), f"{pii.KINDS[k]}:*"):
                near_any.setdefault(entity, set()).update((i, n) for n, _ in near)
                for n, x in near:
                    if x:
                        contexts.setdefault((entity, x), set()).add(key)
                        if whole[n] == x:
                            near_of.setdefault((entity, x), set()).add((i, n))
    share = {}
    for (entity, x), places in near_of.items():
        if len(contexts[entity, x]) >= pii.SUPPORT:
            rare = min(0.5, len(near_any[entity]) / positions)
            value = 1 - math.log(len(places) / total[x]) / math.log(rare)
            if value >= pii.ALPHA:
                share[x] = max(value, share.get(x, 0))
    out = {}
    for i, t in texts.items():
        spans = brute_pii(t or "")
        for m in word.finditer(t or ""):
            core = m[0].strip(pii.PUNCTUATION)
            if core and pii.terms(m[0]) in share:
                a = m.start() + m[0].index(core)
                if not any(s < a + len(core) and a < e for s, e, _ in spans):
                    out.setdefault(i, set()).add((a, a + len(core), 4))
    return out, {x for x, v in share.items() if v >= 1}


def test_term_spans_are_those_of_plain_counts(spark, docs):
    extra = ["İstanbul (İİİİstanbul) next", "Zoë's Ünïcode—word kim@example.org Ünïcode", "x"]
    extra += [f"{w} zorblatt İzmir kim{i % 3}@example.org {w}{w} Wörter, (zorblatt)" for i, w in enumerate(["some", "more", "that", "this", "some"] * 2)] + ["İzmir, zorblatt"]
    texts = {**docs[1], **{-i - 1: t for i, t in enumerate(extra)}}
    df = spark.createDataFrame(pd.DataFrame({"doc_id": texts.keys(), "text": texts.values()}))
    got = {r["doc_id"]: r for r in pii.detect(df).collect()}
    want, removed = brute_terms(texts)
    assert {i: {(s["start"], s["end"], 4) for s in r["spans"] if s["kind"] == 4} for i, r in got.items() if any(s["kind"] == 4 for s in r["spans"])} == want
    assert len(want) > 10
    for i, r in got.items():
        t = texts[i]
        for s in r["spans"]:
            assert s["removed"] == (s["kind"] == 4 and pii.terms(t[s["start"] : s["end"]]) in removed)
        assert r["sanitised"] == pii.sanitise(t, [tuple(s) for s in r["spans"]])
        assert not brute_pii(r["sanitised"] or "") or "[" in r["sanitised"]


def test_contexts_are_whole_words():
    rng = random.Random(11)
    parts = ["x" * 400, "word", "Zorblatt,", "一二三四五六" * 60, "kim@example.org", "10.1.2.3", "mail:kim@example.org,", "+1 555 123 4567", "a", "9"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) + rng.choice(["", " ", "  ", "\n"]) for _ in range(rng.randint(1, 30)))
        spans = pii.base_spans(t)
        for (s, e, _), c in zip(spans, pii.contexts(t, spans), strict=True):
            near = pii.WORD.findall(t[:s])[-pii.NEAR :] + pii.WORD.findall(t[e:])[: pii.NEAR]
            assert c["terms"] == sorted({x for x in map(pii.terms, near) if x})


def test_repeated_rows_and_clashing_columns(spark):
    rows = [(1, "ask kim@example.org now", 1, "a"), (1, "ask kim@example.org now", 2, "b"), (None, "ask kim@example.org now", 3, "c"), (2, None, 4, "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, hash int, term string")
    got = pii.detect(df).collect()
    assert sorted((r["doc_id"] or 0, len(r["spans"])) for r in got) == [(0, 1), (1, 1), (1, 1), (2, 0)]


def test_keys_joined_to_a_name(spark):
    rng = random.Random(4)
    al = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    keys = ["".join(rng.choice(al) for _ in range(40)) for _ in range(20)]
    names = ["credential=", "auth=", "https://host/path?sig=", "private_key="]
    texts = [f"x {names[i % 4]}{k}{'=' * (i % 3)} y" for i, k in enumerate(keys)] + ["x a_long_name_of_a_setting=another_long_name_of_it y"]
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in secrets.detect(frame(spark, texts)).collect()}
    hit = [i for i in range(20) if got[i] == [(texts[i].index(keys[i]), len(texts[i]) - 2, 3)]]
    assert len(hit) >= 18 and not got[20]
