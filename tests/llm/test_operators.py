"""Each operator against a brute-force version, an exact round trip or held-out accuracy, and on odd rows."""

import hashlib
import os
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from deltaweave.llm import ann, chat, decontam, gbt, neardup, pii, quality, queries, sharding, spm, toxicity, urlfilter

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, extra=None):
    rows = [(i if not isinstance(t, tuple) else t[0], t if not isinstance(t, tuple) else t[1], "en", "s", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


ODD = [None, "", "   ", "word", "word", (None, "word"), (3, "word"), "!!! ???", "\n\n", "x" * 200_000, "é ñ ß 日本 \U0001f600"]


# ---------------------------------------------------------------- PII
def test_pii_formats_coreference_distinctness(spark):
    texts = [
        "mail a.b@shop.example.com or A.B@SHOP.EXAMPLE.COM, c@shop.example.com",
        "call +1 (437) 555-0689 and +1 437 555 0689 now",
        "ip 10.1.2.3 card 4111111111111111 and 4111-1111-1111-1111",
        'token = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce"',
        "Mr. John Smith met Mrs. Smith; Frau Müller, господин Иванов",
        "ssn 123-45-6789 iban DE44500105175407324931",
        "nothing here, 12 and 2004-01-02",
        *ODD,
    ]
    out = pii.surrogates(docs_of(spark, texts), kinds_col="kinds").collect()
    by = {r.doc_id: r for r in out if r.doc_id is not None and r.doc_id < 7}
    t = {k: r.text for k, r in by.items() if r.doc_id < 7}
    mails = re.findall(r"\S+@[\w.]+", t[0])
    assert mails[0].lower() == mails[1].lower() and mails[1].isupper() is False or mails[1] == mails[0].upper()
    assert {m.split("@")[1].lower() for m in mails} == {mails[0].split("@")[1].lower()} and "shop" not in t[0].lower()
    assert mails[2] != mails[0]
    a, b = re.findall(r"\+1[ \d()-]+\d", t[1])
    assert re.sub(r"\D", "", a) == re.sub(r"\D", "", b) != "14375550689" and re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", a)
    c1, c2 = re.search(r"card (\S+) and (\S+)", t[2]).groups()
    assert c1 == c2.replace("-", "") != "4111111111111111" and c1[0] == "4" and len(c1) == 16
    assert sum(int(d) if i % 2 == 0 else sum(map(int, str(2 * int(d)))) for i, d in enumerate(reversed(c1))) % 10 == 0
    assert re.search(r"ip \d+\.\d+\.\d+\.\d+ ", t[2]) and "10.1.2.3" not in t[2]
    assert re.fullmatch(r'token = "[0-9a-f]{40}"', t[3]) and "b44e15" not in t[3]
    m = re.fullmatch(r"Mr\. (\w+) (\w+) met Mrs\. (\w+); Frau (\w+), господин (\w+)", t[4])
    assert m[2] == m[3] != "Smith" and m[1].endswith("o") and re.fullmatch(r"[А-Яа-я]+ов", m[5])
    assert re.fullmatch(r"ssn \d{3}-\d{2}-\d{4} iban DE\d{20}", t[5])
    assert t[6] == texts[6]
    odd = Counter((r.doc_id, r.text) for r in out if not (r.doc_id is not None and r.doc_id < 7)) + Counter((r.doc_id, r.text) for r in out if r.doc_id == 3 and r.text == "word")
    assert sum(1 for r in out) == len(texts) and odd


def test_pii_collisions_are_resolved(spark):
    # 900 one-byte-per-digit entities of one layout and a crowded space
    n = 200
    rows = [(i, f"call ({i % 10}{i // 10 % 10}{i // 100}) 555-0100 now") for i in range(n)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.text for r in pii.surrogates(d).collect()}
    assert len(set(out.values())) == n and not set(out.values()) & {t for _, t in rows}
    entities = spark.createDataFrame([("ssn", f"{i:03d}") for i in range(150)], "kind string, norm string")
    m = pii.assign(entities, "k").collect()  # 150 of 1000: all but certain collisions
    assert len({r.sur for r in m}) == 150 and all(r.sur != r.norm for r in m)


def test_pii_phone_ends_before_what_follows(spark):
    phones = ["+1 (826) 555-4081", "+1 826 555 4081", "+18265554081", "+1-826-555-4081", "+44 20 7946 0958", "+49 (30) 1234-5678", "+7 495 123-45-67", "+44 20-7946 0958"]
    others = [("ip", "190.137.223.204"), ("card", "4524132264652876"), ("card", "4111 1111 1111 1111"), ("ssn", "123-45-6789"), ("phone", "826-555-4082"), ("phone", "(826) 555-4082"), ("phone", "+1 (826) 555-4082"), ("email", "a@b.example.com"), ("secret", "b44e15e09fd311c3cf3163b66d5a9875b883d8ce"), ("iban", "DE44500105175407324931"), ("name", "Mr. John Smith")]
    cases = [(p, *o) for p in phones for o in others] + [(p, None, n) for p in phones for n in ("2004-01-02 on", "3.14 m", "10:30 now", "12345 left")] + [(p, None, "190 people") for p in (*phones[:4], phones[5], phones[6])]
    rows = [(i, f"at {p} {o}.") for i, (p, _, o) in enumerate(cases)] + [(1000 + i, f"at {p}.") for i, p in enumerate(phones)]
    got = {r.doc_id: r for r in pii.surrogates(spark.createDataFrame(rows, "doc_id long, text string"), kinds_col="kinds").collect()}
    alone = {p: got[1000 + i].text[3:-1] for i, p in enumerate(phones)}
    for i, (p, kind, o) in enumerate(cases):
        text = got[i].text
        assert text.startswith(f"at {alone[p]} ") and got[i].kinds == (["phone", kind] if kind else ["phone"]), (rows[i], text)
        assert (f" {o}." in text) == (kind is None), (rows[i], text)


def test_pii_is_keyed_and_stable(spark):
    d = docs_of(spark, ["a@b.example.org x"])
    one, two = (pii.surrogates(d.repartition(k), key="k").first().text for k in (1, 3))
    assert one == two != pii.surrogates(d, key="other").first().text


def test_pii_names_without_title_and_secrets_without_digits(spark):
    secret = "sk-" + "abcdefghij" * 2
    texts = ["Mr. John Smith came. Later John Smith and SMITH left; Smithson and Johnny stayed.", f"key {secret} here", f"key {secret} and 7", "Dr. Ada King met King Ada", "Mr. Bo Li: Li"]
    t = {r.doc_id: r.text for r in pii.surrogates(docs_of(spark, texts)).collect()}
    m = re.fullmatch(r"Mr\. (\w+) (\w+) came\. Later (\w+) (\w+) and SMITH left; Smithson and Johnny stayed\.", t[0])
    assert m and m[1] == m[3] != "John" and m[2] == m[4] != "Smith"
    a, b = t[1].split()[1], t[2].split()[1]
    assert a == b != secret and a.startswith("sk-") and len(a) == len(secret)
    m = re.fullmatch(r"Dr\. (\w+) (\w+) met (\w+) (\w+)", t[3])
    assert m and m[1] == m[4] != "Ada" and m[2] == m[3] != "King"
    assert t[4].endswith(": Li")  # two letters are no clue


def test_pii_names_never_run_out(spark):
    n = 6000  # 400 names of two syllables
    d = spark.range(n).select(F.lit("surname:l").alias("kind"), F.concat(F.lit("n"), F.col("id")).alias("norm"))
    m = pii.assign(d, "k").collect()
    assert len(m) == n == len({r.sur.lower() for r in m})


def test_pii_empty_table_and_clashing_columns(spark):
    d = docs_of(spark, ["a@b.example.org x", None]).withColumn("kinds", F.lit("clash")).withColumn("kind", F.lit(1)).withColumn("m", F.lit(2))
    assert pii.surrogates(d.limit(0), kinds_col="kinds").count() == 0
    got = pii.surrogates(d, kinds_col="kinds").collect()
    assert sorted(str(r.kinds) for r in got) == ["['email']", "[]"] and all((r.kind, r.m) == (1, 2) for r in got)


# ---------------------------------------------------------------- ANN
def brute(rows, k):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    out = {}
    for j, i in enumerate(ids):
        if i % 20 == 0:
            s = x @ x[j]
            order = [int(o) for o in np.lexsort((ids, -s)) if ids[o] != i][:k]
            out[int(i)] = [(int(ids[o]), float(s[o])) for o in order]
    return out


def test_ann_recall_ties_and_odd_vectors(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in e.collect()]
    rows += [(1000 + i, rows[40][1]) for i in range(60)]  # ties with vector 40
    d = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows] + [(2000, None), (2020, [0.0] * 64), (2040, [float("nan")] * 64), (2060, [1.0, None] + [0.0] * 62), (2080, [1.0])], "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in ann.nearest(d, d.where("vec_id % 20 = 0")).sort("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    want = brute(rows, 20)
    assert got.keys() == want.keys()
    hit = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want) / sum(map(len, want.values()))
    assert hit >= 0.9
    assert [v for v, _ in got[40]][:20] == [v for v, _ in want[40]][:20]
    x = {i: np.array(v, float) for i, v in rows}
    assert all(abs(s - float(x[q] @ x[v])) < 1e-12 for q in got for v, s in got[q])


def test_ann_few_rows(spark):
    d = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in ann.nearest(d, d.where("vec_id = 0")).collect()] == [(0, 1, 1, 0.5)]
    assert ann.nearest(d.limit(0), d).count() == 0 and ann.nearest(d, d.limit(0)).count() == 0


def test_ann_scan_loses_few_neighbours():
    """Random, clustered and off-centre vectors, and lengths of all sizes: next to brute force with a bar of the k-th best, all
    without one."""
    rng = np.random.default_rng(4)
    around = rng.standard_normal((20, 64))
    tables = (rng.standard_normal((3000, 64)), around[rng.integers(0, 20, 3000)] + 0.3 * rng.standard_normal((3000, 64)), 5 + rng.standard_normal((3000, 64)), rng.standard_normal((3000, 64)) * rng.lognormal(0, 1, (3000, 1)))
    for x in tables:
        turn = np.linalg.qr(rng.standard_normal((64, 64)))[0]
        q = x[:100]
        want = np.sort(q @ x.T, 1)[:, ::-1][:, :21]
        i, j, s = ann.scan(q @ turn, x @ turn, np.full(100, -np.inf), 3.0)
        assert len(i) == 300_000 and np.allclose(s, (q @ x.T)[i, j])
        i, j, s = ann.scan(q @ turn, x @ turn, want[:, 20], 3.0)
        assert np.allclose(s, (q @ x.T)[i, j]) and 2100 * 0.98 <= len(s) <= 2100


def test_ann_prunes_lists_and_keeps_recall(spark):
    """140 lists; of clustered vectors few are probed.  All queries with an id divisible by 20, against brute force."""
    rng = np.random.default_rng(12)
    around = rng.standard_normal((300, 32))
    x = around[rng.integers(0, 300, 20_000)] + 0.25 * rng.standard_normal((20_000, 32))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("list", F.lit("clash")).withColumn("qid", F.lit(0))
    seen, packed = [], ann.packed
    ann.packed = lambda count: seen.append(len(count)) or packed(count)
    try:
        got = defaultdict(set)
        for r in ann.nearest(d, d.where("vec_id % 20 = 0")).collect():
            got[r.query_id].add(r.vec_id)
    finally:
        ann.packed = packed
    want = brute(rows, 20)
    assert seen == [141] and got.keys() == want.keys()
    assert sum(len(got[i] & {v for v, _ in want[i]}) for i in want) / sum(map(len, want.values())) >= 0.93


def test_ann_cells():
    first, parts = ann.packed(np.array([10, 4000, 100, 0, 9000, 5, 4096]))
    assert first.tolist() == [0, 0, 1, 1, 2, 5, 6] and parts.tolist() == [1, 1, 1, 1, 3, 1, 1]


# ---------------------------------------------------------------- near duplicates
def classes_by_force(texts, threshold=0.8):
    def shingles(t):
        w = re.findall(r"\w+", (t or "").lower())
        return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()

    bags, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            a, b = bags[i], bags[j]
            common = sum((a & b).values())
            if (texts[i] and texts[i] == texts[j]) or (a and common >= threshold * (sum(a.values()) + sum(b.values()) - common)):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(texts))]


def test_neardup_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [[str(w) for w in rng.choice(vocabulary, int(n))] for n in rng.integers(3, 300, 60)]
    texts = [" ".join(b) for b in base]
    for b in base[:25]:
        for rate in (0.0, 0.005, 0.01, 0.02, 0.04, 0.08):
            texts.append(" ".join(str(rng.choice(vocabulary)) if rng.random() < rate else w for w in b))
    chain = [str(w) for w in rng.choice(vocabulary, 200)]  # neighbours are near, ends are not
    for i in range(8):
        chain = chain[6:] + [str(w) for w in rng.choice(vocabulary, 6)]
        texts.append(" ".join(chain))
    texts += [None, "", "", "!!!", "!!!", "a b", "a b", "a a a a a a a a a a a a a", "a a a a a a a a a a a a", "rep " * 3000, "rep " * 2900]
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs_of(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == classes_by_force(texts)


def test_neardup_large_buckets_lose_no_link(spark, monkeypatch):
    """Over 32 texts around one passage share buckets; most links are between texts that are no hub."""
    rng = np.random.default_rng(8)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = [str(w) for w in rng.choice(vocabulary, 160)]
    texts = []
    for i in range(90):
        own = [str(w) for w in rng.choice(vocabulary, 40)]
        texts.append(" ".join(passage + own))
        if i % 3 == 0:
            texts.append(" ".join(passage + [*own[:34], *map(str, rng.choice(vocabulary, 6))]))
        if i % 9 == 0:  # a link with repeated shingles
            texts.append(" ".join(passage + own + own[:12]))
    seen, dealt = [], neardup.prefix_tokens
    monkeypatch.setattr(neardup, "prefix_tokens", lambda *a: seen.append(1) or dealt(*a))
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs_of(spark, texts)).collect()}
    want = classes_by_force(texts)
    assert seen and 1 < len(set(want)) < len(texts)
    assert [got[i] for i in range(len(texts))] == want


def test_bagminhash_is_unbiased():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**63, 300, dtype=np.uint64)
    a = (np.sort(keys[:200]), rng.integers(1, 9, 200))
    b = (np.sort(keys[60:260]), rng.integers(1, 9, 200))
    want = neardup.similarity(a, b)
    s = neardup.signatures([a, b, (np.zeros(0, np.uint64), np.zeros(0, int))], 20_000)
    assert abs((s[0] == s[1]).mean() - want) < 0.015 and not s[2].any()


def test_keep_one(spark):
    t = "one two three four five six seven eight nine ten"
    d = docs_of(spark, [t, t, t + " eleven", "other words entirely here now", (3, "other words entirely here now"), None, ""])
    assert sorted(r.doc_id for r in neardup.keep_one(d).collect()) == [0, 3, 5, 6]
    assert neardup.keep_one(d.limit(0)).count() == 0


def test_keep_one_with_null_and_repeated_ids(spark):
    t, u, v, w = ("one two three four five six seven eight nine ten", "other words entirely here now", "a third text that is like none", "a fourth one of its own kind")
    rows = [(0, t), (None, t), (None, u), (None, v), (2, t), (2, w), (7, "red text about seas"), (7, "blue text about hills"), (7, "red text about seas"), (9, None), (9, "green text about roads"), (None, None), (8, ""), (8, None)]
    got = Counter(tuple(r) for r in neardup.keep_one(docs_of(spark, rows)).select("doc_id", "text").collect())
    blank = [k for k in got if k[0] == 8]
    assert len(blank) == 1 and got.pop(blank[0]) == 1
    assert got == Counter([(0, t), (None, u), (None, v), (2, w), (7, "red text about seas"), (7, "blue text about hills"), (9, None), (9, "green text about roads"), (None, None)])


# ---------------------------------------------------------------- SentencePiece
def test_spm_equals_the_library(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=spm.DEFAULT_MODEL)
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    texts += ["", " ", "  a", "a ", "a\tb\n\nc", "▁ x", "<s> </s> <unk> <0x0A>", "日本語 \U0001f600 Ａﬁ", "\x00", "    " * 9 + "x", "aaaa" * 500]
    m = spm.matcher(spm.DEFAULT_MODEL)
    got = m.encode(texts)
    for g, t in zip(got, texts, strict=True):
        assert g.tolist() == sp.encode(t), t[:80]
    assert all(m.decode(g) == t for g, t in zip(got, texts, strict=True) if "▁" not in t)


def test_spm_query_and_odd_rows(spark):
    d = docs_of(spark, ODD).withColumn("ids", F.lit("clash"))
    out = spm.encode(d, check_col="ok")
    rows = out.collect()
    assert len(rows) == len(ODD) and all(r.ok for r in rows)
    assert all(list(r.ids) == [] for r in rows if not r.text)
    back = spm.decode(out.select("doc_id", "ids", F.col("text").alias("t"))).collect()
    assert all(r.text == (r.t or "") for r in back)


def test_spm_unigram_best_path():
    pieces = ["<unk>", "▁", "a", "b", "ab", "▁a", "ba", "bab"]
    scores = [0, -2.0, -2.0, -2.5, -3.0, -3.0, -3.1, -4.0]
    m = spm.Matcher(spm.Vocabulary(pieces, scores, {}, {0}, 0, "unigram"))

    def force(w):
        best = {0: (0.0, [])}
        for j in range(len(w)):
            if j in best:
                for i in range(1, len(pieces)):
                    if w.startswith(pieces[i], j):
                        e, s = j + len(pieces[i]), best[j][0] + scores[i]
                        if e not in best or s > best[e][0]:
                            best[e] = (s, best[j][1] + [i])
        return best[len(w)][1]

    for w in ("ababab", "bab", "abba", "aab"):
        assert m.encode([w])[0].tolist() == force("▁" + w)


def test_spm_huge_words_equal_the_library(monkeypatch):
    """Words that are indexed in blocks, with a memory that forgets after every batch."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=spm.DEFAULT_MODEL)
    rng = np.random.default_rng(6)
    letters = lambda alphabet, n: "".join(rng.choice(list(alphabet), n))
    words = ["x" * 1001, "-" * 1037, "ab" * 700, letters("abcdefghijklmnopqrstuvwxyz", 3000), letters("esatinr", 4000), letters("ab日é\U0001f600=", 1500), "=" * 300 + "tion" * 200 + "-" * 77]
    monkeypatch.setattr(spm, "HUGE", 100)
    m = spm.Matcher(spm.Vocabulary.read(spm.DEFAULT_MODEL), memory=1000, batch_chars=256)
    texts = [*words, " ".join(words), "a b " + words[3] + " c", *words]
    for at in range(0, len(texts), 2):
        for g, t in zip(m.encode(texts[at : at + 2]), texts[at : at + 2], strict=True):
            assert g.tolist() == sp.encode(t), t[:40]
            assert m.decode(g) == t
    assert m.relax_bpe_huge("▁" + words[4]) is not None


def test_spm_memory_is_bounded():
    """A word of five million letters and many new words, in a process of its own."""
    import subprocess
    import sys

    code = """
import random, resource
from deltaweave.llm import spm
m = spm.matcher(spm.DEFAULT_MODEL)
r = random.Random(1)
for k in range(20):
    m.encode([" ".join("".join(r.choices("etaoinshrdlu", k=9)) for _ in range(2000)) for _ in range(8)])
ids = m.encode(["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=5_000_000))])[0]
print(len(ids), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), timeout=600).stdout.split()
    assert int(out[0]) > 1_000_000 and int(out[1]) < 600, out


def test_spm_new_words_are_cheap():
    """CPU of a batch of new words, in sorts of as many numbers as it has characters; long words are indexed together."""
    import time

    import sentencepiece

    rng = np.random.default_rng(8)
    word = lambda n: "".join(rng.choice(list("etaoinshrdluéè"), n))
    numbers = rng.integers(0, 1 << 62, spm.BATCH_CHARS)
    m = spm.Matcher(spm.Vocabulary.read(spm.DEFAULT_MODEL))

    def seconds(f, *args, **more) -> float:
        began = time.process_time()
        f(*args, **more)
        return time.process_time() - began

    took = [seconds(m.encode, [" ".join(word(11) for _ in range(5400))]) / seconds(np.argsort, numbers, kind="stable") for _ in range(7)]
    assert np.median(took) < 15, took
    calls, plain = [], m.occurrences
    m.occurrences = lambda s: calls.append(len(s)) or plain(s)
    text = " ".join(word(n) for n in range(spm.LONG, spm.LONG + 100))
    assert m.encode([text])[0].tolist() == sentencepiece.SentencePieceProcessor(model_file=spm.DEFAULT_MODEL).encode(text)
    assert len(calls) <= 3, calls


def test_spm_model_with_another_normaliser_is_an_error(tmp_path):
    with open(spm.DEFAULT_MODEL, "rb") as f:
        whole = f.read()
    field = lambda n, body: bytes([n << 3 | 2]) + bytes([len(body) & 127 | 128, len(body) >> 7]) + body
    other = tmp_path / "other.model"
    other.write_bytes(whole + field(3, b"\x18\x00"))
    assert len(spm.fields(whole)[1]) == 32_000
    with pytest.raises(ValueError, match="keep text"):
        spm.Vocabulary.read(str(other))


# ---------------------------------------------------------------- classifiers
def auc(score, y):
    order = np.argsort(score, kind="stable")
    r = pd.Series(score).rank().to_numpy()
    del order
    return (r[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))


def held(spark, out, labels, label):
    t = out.where("held_out").join(labels, "doc_id").select("score", "predicted", label).toPandas()
    return t.score.to_numpy(), t[label].to_numpy(), t.predicted.to_numpy()


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    s, y, p = held(spark, queries.op5_toxicity(spark, sf), spark.read.parquet(f"{sf}/labels.parquet"), "toxic")
    assert auc(s, y) > 0.92 and (p == y).mean() > 0.96 and ((s >= 0) & (s <= 1)).all()
    assert y[p == 1].mean() > 0.85 and p[y == 1].mean() > 0.8


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    s, y, p = held(spark, queries.op6_quality_rules(spark, sf), spark.read.parquet(f"{sf}/labels.parquet"), "quality")
    assert auc(s, y) > 0.8 and (p == y).mean() > 0.9


def test_classifiers_odd_rows(spark):
    d = docs_of(spark, ODD)
    labels = spark.createDataFrame([(0, 1, 0), (3, 0, 1), (None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    for module, label in ((toxicity, "toxic"), (quality, "quality")):
        for lab in (labels, labels.limit(0)):
            model = module.fit(d, lab, label, usable=F.lit(True))
            rows = module.score(d.withColumn("score", F.lit("clash")), model).collect()
            assert len(rows) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
        assert module.score(d.limit(0), model).count() == 0


def test_obfuscation_is_undone():
    assert "idiot" in toxicity.terms_of("you 1d10t") and "stupid" in toxicity.terms_of("$tup1d!")
    f = dict(zip(toxicity.NAMES, toxicity.features("you are an 1d10t", toxicity.Known({})), strict=True))
    assert f["fixed_count"] == 1 and f["nearest_second"] == 3 and f["obfuscated_rate"] == 0.25


def test_rules_compile_to_the_same_scores(spark):
    t = spark.read.parquet(f"{SF}/documents.parquet")
    stats = t.select(*(c.alias(n) for n, c in quality.statistics(F.col("text")).items())).toPandas().to_numpy(float)
    y = (stats[:, 4] > np.median(stats[:, 4])).astype(float)
    model = quality.fit_rules(stats, y)
    got = np.array([r.score for r in quality.score(t, model).collect()])
    assert model.rules and np.allclose(got, model.predict(stats)) and auc(got, y) > 0.95


def test_isotonic_is_monotone():
    rng = np.random.default_rng(0)
    s = rng.random(500)
    x, p = gbt.isotonic(s, (rng.random(500) < s).astype(float))
    assert (np.diff(x) >= 0).all() and (np.diff(p) >= 0).all() and np.abs(np.interp([0.2, 0.8], x, p) - [0.2, 0.8]).max() < 0.15


# ---------------------------------------------------------------- sharding
@pytest.mark.parametrize("bucket_bytes", [1 << 12, 1 << 24])
def test_sharding_law(spark, bucket_bytes):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(None, None)] * 5 + [(7, "same")] * 1100, "doc_id long, text string"))
    out = sharding.shard(d.withColumn("slot", F.lit("clash")).drop("slot"), 40, bucket_bytes=bucket_bytes)
    rows = out.collect()
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in d.collect())
    assert set(by) == set(range(40)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


def test_sharding_is_seeded_and_shuffled(spark):
    d = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    run = lambda n, **k: {r.doc_id: (r.shard, r.slot) for r in sharding.shard(d.repartition(n), 4, bucket_bytes=8000, **k).collect()}
    a = run(3)
    assert a == run(7) != run(3, seed=8)
    place = np.array([a[i][0] * 500 + a[i][1] for i in range(2000)])
    assert abs(np.corrcoef(place, np.arange(2000))[0, 1]) < 0.1
    assert sharding.shard(d.limit(0), 4).count() == 0


def test_sharding_of_a_hot_id_is_fixed_by_the_seed(spark):
    d = spark.range(1500).select(F.lit(1).cast("long").alias("doc_id"), F.lit("t").alias("text"), (F.col("id") % 3).alias("shard"), (F.col("id") % 2).alias("extra"))
    d = d.unionByName(spark.range(500).select(F.col("id").alias("doc_id"), F.lit("u").alias("text"), F.lit(0).cast("long").alias("shard"), F.lit(7).cast("long").alias("extra")))
    run = lambda n: Counter(tuple(r) for r in sharding.shard(d.repartition(n), 4, bucket_bytes=6000).collect())
    a = run(2)
    assert a == run(5) and sum(a.values()) == 2000 == len({(r[3], r[4]) for r in a})
    assert max(Counter(r[3] for r in a).values()) == 500


def test_write_shards(spark, tmp_path):
    d = spark.range(100).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    sharding.write_shards(d, str(tmp_path / "out"), shards=5)
    assert len([p for p in os.listdir(tmp_path / "out") if p.startswith("shard=")]) == 5


# ---------------------------------------------------------------- URL filters
def test_url_rules_by_force(spark):
    rules = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("a.example.com", "", "block"), ("net", "/", "allow"), ("com", "/en/", "allow"), (None, "/", "block")]
    urls = ["http://x.example.com/en/742?q#f", "HTTP://X.Example.COM/en/8", "https://a.example.com", "http://net/de", "http://ample.com/en/7", "nothing", None, "", "http://", "http://EXAMPLE.com?x/en/7", "ftp://q.net/#/", "http://É.com/en/"]
    d = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)] + [(0, urls[0], "clash")], "page_id long, url string, host string")
    r = spark.createDataFrame(rules, "host string, path string, verdict string")

    def force(u):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = ("".join(c.lower() if c.isascii() else c for c in m[1]), m[2]) if m else ("", "")
        fit = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if h is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(max(fit)[3:] if fit else (None, "allow")))

    for bound in (urlfilter.BROADCAST_RULES, 1):
        urlfilter.BROADCAST_RULES, old = bound, urlfilter.BROADCAST_RULES
        got = sorted(((x.page_id, (x.host, x.path, x.rule, x.verdict)) for x in urlfilter.judge_urls(d, r).collect()), key=str)
        urlfilter.BROADCAST_RULES = old
        assert got == sorted([(i, force(u)) for i, u in enumerate(urls)] + [(0, force(urls[0]))], key=str)
    assert {x.verdict for x in urlfilter.judge_urls(d, r.limit(0)).collect()} == {"allow"}


def test_url_rules_of_many_lengths(spark):
    r = spark.createDataFrame([("a.com", "/" + "x" * i, "block" if i == 2199 else "allow") for i in range(2200)], "host string, path string, verdict string")
    d = spark.createDataFrame([(0, "http://a.com/" + "x" * 2500), (1, "http://a.com/xx")], "page_id long, url string")
    got = {x.page_id: (len(x.rule), x.verdict) for x in urlfilter.judge_urls(d, r).collect()}
    assert got == {0: (2205, "block"), 1: (8, "allow")}


# ---------------------------------------------------------------- decontamination
def edit_distance_in(p, t):
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        new = [i]
        for j, x in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != x)))
        row = new
    return min(row)


def test_myers_against_dynamic_programming():
    rng = np.random.default_rng(3)
    for _ in range(300):
        p = "".join(rng.choice(list("abc"), rng.integers(1, 90)))
        t = "".join(rng.choice(list("abc"), rng.integers(0, 120)))
        d = edit_distance_in(p, t)
        assert decontam.myers(p, t, len(p))[0] == d


def test_decontamination_by_force(spark):
    rng = np.random.default_rng(9)
    words = [f"{a}{b}" for a in "abcdefgh" for b in ("ing", "er", "on", "est", "th")]
    items = [" ".join(rng.choice(words, 30)) for _ in range(12)]
    texts = []
    for k in range(60):
        t, i = " ".join(rng.choice(words, 120)), items[k % 12]
        i = list(i)
        for _ in range(k % 11):
            j = int(rng.integers(len(i)))
            i[j : j + 1] = [[], ["q"], [i[j], "z"]][int(rng.integers(3))]
        texts.append(t[:200] + " " + "".join(i).upper() + "\n\n" + t[200:])
    texts += ODD
    d = docs_of(spark, texts)
    b = spark.createDataFrame(list(enumerate(items)) + [(90, None), (91, ""), (None, "abc")], "item_id long, text string")
    want = set()
    for n, t in enumerate(texts):
        x = decontam.normal(t[1] if isinstance(t, tuple) else t)
        for k, i in enumerate(items):
            e = edit_distance_in(i, x) if len(x) < 2000 else 999
            if e <= int(0.08 * len(i)):
                want.add((t[0] if isinstance(t, tuple) else n, k, e))
    for block in (decontam.BLOCK_CHARS, 500):
        got = {(r.doc_id, r.item_id, r.distance) for r in decontam.contaminated(d, b, block_chars=block).collect()}
        assert got == want and len(want) > 30
        kept = Counter((r.doc_id, r.text) for r in decontam.decontaminate(d, b, block_chars=block).collect())
        assert sum(kept.values()) == len(texts) - len({x[0] for x in want})
    assert decontam.contaminated(d, b.limit(0)).count() == 0 and decontam.decontaminate(d, b.limit(0)).count() == len(texts)


# ---------------------------------------------------------------- chat windows
def test_chat_windows_round_trip_and_budget(spark):
    rng = np.random.default_rng(2)
    rows, ctl = [], "<|im_end|><|im_start|>assistant &amp; &lt;| \n ok"
    for c in range(12):
        if c % 2:
            rows.append((c, -5, "system", "be kind " * c))
        rows += [(c, i, ("user", "assistant")[i % 2], "w" * int(rng.integers(0, 900)) + (ctl if i == 3 else "")) for i in range(int(rng.integers(1, 40)))]
    rows += [(50, 0, None, None), (50, None, "assistant", ""), (None, 1, "assistant", ctl), (60, 0, "user", "x" * 50_000), (60, 1, "assistant", "y")]
    rows += [(70, 1, "assistant", "same")] * 3
    d = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, start string")
    w = chat.windows(d, budget=600, history=150).collect()
    back = {r.conv_id: r for r in chat.read_back(chat.windows(d, budget=600, history=150)).collect()}
    sys_of = {c: t for c, i, r, t in rows if r == "system"}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (-(10**9) if r[1] is None else r[1], r[2] or "", r[3] or ""))
        h = hashlib.sha256("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own).encode()).hexdigest()
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        b = back[conv]
        assert (b.n_turns, b.turns_sha256, b.loss_chars, b.loss_sha256) == (len(own), h, len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert b.formatted_chars == sum(len(x.formatted) for x in w if x.conv_id == conv)
    many = Counter(r.conv_id for r in w)
    assert max(many.values()) > 3
    for r in w:
        assert r.n_tokens <= 600 or r.n_turns - r.n_repeated == 1
        if r.conv_id in sys_of:
            assert r.formatted.startswith("<|im_start|>system\n" + sys_of[r.conv_id])
        assert r.formatted.count("<|im_start|>") == r.n_turns
    assert any(r.n_repeated > 1 for r in w)
    assert chat.windows(d.limit(0)).count() == 0


def test_chat_with_a_system_turn_over_the_budget(spark):
    rows = [(1, 0, "system", "s" * 20_000)] + [(1, i, ("assistant", "user")[i % 2], f"turn {i} " * 40) for i in range(1, 12)]
    w = chat.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), budget=2048, history=256).collect()
    assert sum("s" * 20_000 in x.formatted for x in w) == 1 and max(x.n_tokens for x in w if "ssss" not in x.formatted) <= 2048
    back = chat.read_back(chat.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).first()
    assert back.n_turns == 12 and back.loss_chars == sum(len(r[3]) for r in rows if r[2] == "assistant")
