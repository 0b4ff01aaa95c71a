"""The training-data operators against brute force on small inputs, with nulls, ties, repeats, long and empty texts."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from panelforge.llm import contamination, counts, neardup, packing, pstable, quality, simhash, suffixes, tokenfile, tokens, toxicity, warc
from panelforge.llm.common import scratch
from panelforge.llm import components as component_module
from panelforge.llm.components import components, min_labels
from panelforge.llm.labelled import labelled
from panelforge.llm.tokens import Encoder

BYTE, WORD = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))
SCHEMA = "doc_id long, text string, component_id string, h int, fp string, label string"


def texts(seed: int = 1, n: int = 40) -> list[tuple[int | None, str | None]]:
    """Random prose with copies, near copies, empty and null texts, a long one, a repeated row and rows without an id."""
    r = random.Random(seed)
    words = ["".join(r.choice("aeiornst") for _ in range(r.randint(2, 8))) for _ in range(300)]
    out: list[tuple[int | None, str | None]] = []
    for i in range(n):
        out.append((i, " ".join(r.choice(words) for _ in range(r.randint(0, 250)))))
    out += [(100, out[3][1]), (101, out[3][1] + " tail"), (102, ""), (103, None), (104, " \n\t "), (105, "Ünïcode, ärger!\nZwei."), (105, "Ünïcode, ärger!\nZwei."), (None, out[4][1]), (None, None), (106, "ab " * 3000), (107, out[5][1][:900] + " x " + out[6][1])]
    r.shuffle(out)
    return out


def frame(spark, rows):
    """With extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "c", 1, "f", "l") for i, t in rows], SCHEMA)


def union(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoder_equals_the_library(path):
    r = random.Random(2)
    odd = ["", "\n", " ", "x  y", "it's 'S", "İ Σς", "<|endoftext|> a", "a\r\nb", "foo_bar-baz...", "日本", " . ,", "é"]
    odd += ["".join(r.choice("aAéß '.,!1_-\n\t|%$<>²µ×") for _ in range(r.randint(1, 30))) for _ in range(2000)]
    e = Encoder(path, most_words=500)
    want = [x.ids for x in Tokenizer.from_file(path).encode_batch(odd, add_special_tokens=False)]
    for low in range(0, len(odd), 300):
        ids, at = e.encode(odd[low : low + 300])
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == want[low : low + 300]


def test_op1_histogram(spark):
    rows = texts()
    t = Tokenizer.from_file(BYTE)
    n = np.array([len(t.encode(x or "", add_special_tokens=False).ids) for _, x in rows])
    sums = counts.suffix_sums(counts.length_histogram(frame(spark, rows), BYTE)).cache()
    got = {x.n_tokens: tuple(x)[1:] for x in sums.collect()}
    assert got == {k: ((n == k).sum(), n[n == k].sum(), (n >= k).sum(), n[n >= k].sum(), (n <= k).sum(), np.minimum(n, k).sum()) for k in set(n.tolist())}
    assert {r[0]: r[1] for r in counts.truncated_totals(sums, [0, 7, 100, 10**6]).collect()} == {k: int(np.minimum(n, k).sum()) for k in (0, 7, 100, 10**6)}
    assert counts.quantiles(sums, [0.5]).first()[1] == sorted(n.tolist())[int(np.ceil(0.5 * len(n))) - 1]
    assert counts.suffix_sums(counts.length_histogram(frame(spark, []), BYTE)).count() == 0


def test_op2_archive(spark):
    rows = [(3, "u", "a" * 200), (1, "u", "a" * 200), (2, "v", "b"), (5, "v", "b"), (None, "x", "a" * 200), (7, None, None), (8, "w", "WARC/1.1\r\n\r\n" * 20), (9, "é", "ü" * 60)]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string")
    path = scratch(spark, "archive")
    warc.write_archive(pages, path)
    records = warc.read_records(spark, path)
    got = sorted(map(tuple, warc.records_summary(records).collect()), key=str)
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        again = h == "a" * 200 and i != 1
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", 1 if again else None))
    assert got == sorted(want, key=str)
    assert sorted(r.payload for r in records.select("payload").collect()) == sorted((h or "").encode() for _, _, h in rows)
    assert spark.read.parquet(path + "/payloads").count() == 5
    warc.export_warc(records, path + "/files")
    back = warc.import_warc(spark, path + "/files").collect()
    assert all(b"\r\nWARC-Date: " in r.header for r in back)
    spark.createDataFrame([("WARC/1.1\r\nWARC-Type: response\r\nWARC-Payload-Digest: sha256:00\r\nContent-Length: 2\r\n\r\nab",)], "value string").write.option("lineSep", "\r\n\r\n").text(path + "/broken")
    with pytest.raises(Exception, match="differs from its header"):
        warc.import_warc(spark, path + "/broken").collect()
    kept = {(bytes(r.header), bytes(r.payload)) for r in records.collect()}
    assert len(back) == len(rows)
    assert all((bytes(r.header), bytes(r.payload)) in kept for r in back if b"revisit" not in r.header)
    warc.write_archive(pages.limit(0), path + "e")
    assert warc.records_summary(warc.read_records(spark, path + "e")).count() == 0


def test_op2_foreign_files(spark, tmp_path):
    """Field names in any case, payloads with line ends, no payload, an empty file; broken records are named."""
    folder = tmp_path / "in"
    folder.mkdir()
    body = b"a\r\n\r\nb"
    named = hashlib.sha256(body).hexdigest().encode()
    first = b"WARC/1.0\r\nwarc-type: response\r\nwarc-payload-digest: sha256:" + named + b"\r\ncontent-length: 6\r\n\r\n" + body + b"\r\n\r\n"
    second = b"WARC/1.1\r\nWARC-Type: revisit\r\nContent-Length:0\r\n\r\n\r\n\r\n"
    (folder / "a.warc").write_bytes(first + second)
    (folder / "b.warc").write_bytes(b"")
    got = warc.import_warc(spark, str(folder)).collect()
    assert sorted(bytes(r.payload) for r in got) == [b"", body] and {r.digest for r in got} == {hashlib.sha256(x).hexdigest() for x in (b"", body)}
    broken = {"no Content-Length": b"WARC/1.1\r\nWARC-Type: response\r\n\r\nx", "file ends within": first[:-8], "payload differs": first.replace(b"a\r\n\r\nb", b"a\r\n\r\nc")}
    for told, raw in broken.items():
        with pytest.raises(ValueError, match=told):
            list(warc._cut_records(raw))


def test_op3_vectors(spark, monkeypatch):
    r = np.random.default_rng(3)
    base = r.standard_normal((60, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([base, base[:20] + 0.05 * r.standard_normal((20, 16)), np.repeat(base[:1], 5, axis=0), base[:3] * 2]))]
    rows += [(200, None), (201, [0.0] * 16), (202, [float("nan")] + [1.0] * 15), (203, [float("inf")] * 16), (204, [1.0]), (205, []), (206, [None] + [1.0] * 15), (None, rows[0][1])]
    # components whose squares leave the range of doubles; an id with several vectors
    rows += [(207, [1e200] * 8 + [-3e200] * 8), (208, [2e200] * 8 + [-6e200] * 8), (209, [1e-200] * 8 + [-3e-200] * 8), (210, [0.0] * 15 + [5e-324])]
    rows += [(211, [0.0] * 5 + [1.0] + [0.0] * 10), (211, [0.0] * 6 + [1.0] + [0.0] * 9), (212, [0.0] * 5 + [1.0, 0.1] + [0.0] * 9), (211, [0.0] * 5 + [1.0] + [0.0] * 10)]
    df = spark.createDataFrame([(*x, 0) for x in rows], "vec_id long, embedding array<double>, copies int")
    fine = {k: np.array(v, float) / np.max(np.abs(v)) for k, (i, v) in enumerate(rows) if i is not None and v and len(v) == 16 and None not in v and np.isfinite(v).all() and np.any(v)}
    links = [(a, b) for a in fine for b in fine if a < b and fine[a] @ fine[b] / np.linalg.norm(fine[a]) / np.linalg.norm(fine[b]) >= 0.9]
    comp, n, least = union(range(len(rows)), links), Counter(x for p in links for x in p), {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[comp[k]] = min(least.get(comp[k], i), i)
    for block in (4096, 4):
        monkeypatch.setattr(pstable, "BLOCK", block)
        got = sorted((tuple(x) for x in pstable.near_vectors(df, miss=1e-6).collect()), key=str)
        assert got == sorted([(i, n[k], least[comp[k]], least[comp[k]] == i) if i is not None else (None, 0, None, False) for k, (i, _) in enumerate(rows)], key=str)
    assert pstable.near_vectors(df.limit(0)).count() == 0
    assert pstable.recall(df.where("vec_id < 100"), pstable.near_vectors(df.where("vec_id < 100")), every=5) >= 0.9


def repeats(rows, length):
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[s : s + length] for _, t in raw for s in range(len(t) - length + 1))
    out = []
    for i, t in raw:
        gone = np.zeros(len(t), bool)
        for s in range(len(t) - length + 1):
            if seen[t[s : s + length]] > 1:
                gone[s : s + length] = True
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        out.append((i, len(t), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def word_counts(rows, least):
    split = [(i, (t or "").encode().lower().split()) for i, t in rows]
    seen = Counter(tuple(w[s : s + least]) for _, w in split for s in range(len(w) - least + 1))
    out = []
    for i, w in split:
        gone = np.zeros(len(w), bool)
        for s in range(len(w) - least + 1):
            if seen[tuple(w[s : s + least])] > 1:
                gone[s : s + least] = True
        out.append((i, int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), int(gone.sum())))
    return sorted(out, key=str)


def assert_report(df, rows):
    assert sorted((tuple(x)[:5] for x in suffixes.removal_report(df).collect()), key=str) == repeats(rows, 400)
    got = suffixes.removal_report(df, suffixes.WORDS, "words").collect()
    assert sorted(((x.doc_id, x.n_spans, x.n_removed) for x in got), key=str) == word_counts(rows, 51)


@pytest.mark.parametrize("hot", [4096, 2])
def test_op4_repeats(spark, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT", hot)
    plain = "".join(random.Random(30).choices("abcdefgh ", k=500))
    rows = [*texts(4), (300, "ab" * 500), (301, "é" * 300), (302, "a" * 399), (303, "a" * 400), (304, "b" * 402)]
    # bytes of value 0 are bytes like any other; a window that runs over a text's end is none
    rows += [(305, plain), (306, plain + "\0" * 50), (307, "\0" * 60 + plain[:450]), (308, "\0" * 900)]
    assert_report(frame(spark, rows), rows)


@pytest.mark.parametrize("hot", [4096, 2])
def test_op4_random_passages(spark, monkeypatch, hot):
    """Bytes beside a repeated passage stay, wherever one anchor follows another, also a multiple of a block on."""
    monkeypatch.setattr(suffixes, "HOT", hot)
    r = random.Random(19)
    some = lambda n: "".join(r.choices("abcdefghijklmnopqrstuvwxyz ", k=n))
    rows = []
    for i in range(200):
        passage = some(r.randint(300, 800))
        rows += [(2 * i + j, some(r.randint(200, 400)) + passage + some(r.randint(200, 400))) for j in range(2)]
    period = some(16 * 30)
    rows += [(1000, some(50) + period * 3 + some(90)), (1001, some(70) + period[160:] + period + some(300))]
    assert_report(frame(spark, rows), rows)


def test_op4_very_long_texts(spark):
    """Texts of several megabytes, beyond the slices that tasks work on."""
    r = np.random.default_rng(31)
    letters = np.frombuffer(b"abcdefghijklmnop     ", np.uint8)
    big = letters[r.integers(0, len(letters), 3_000_000)].tobytes().decode()
    rows = [(1, big), (2, big[1_000_000:1_000_700]), (3, big[2_999_700:] + "tail" * 90), (4, "short")]
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans) for x in suffixes.removal_report(frame(spark, rows)).collect()}
    assert got == {1: (3_000_000, 700, 1), 2: (700, 700, 1), 3: (660, 0, 0), 4: (5, 0, 0)}


def test_op4_columns_and_empty(spark):
    df = frame(spark, texts(5))
    out = suffixes.without_repeats(df)
    assert out.columns == df.columns and out.count() == df.count()
    assert suffixes.removal_report(df.limit(0)).count() == 0


def word_repeats(rows, least):
    split = [(i, t, (t or "").encode().lower().split()) for i, t in rows]
    seen = Counter(tuple(w[s : s + least]) for _, _, w in split for s in range(len(w) - least + 1))
    out = []
    for i, t, w in split:
        gone = {k for s in range(len(w) - least + 1) if seen[tuple(w[s : s + least])] > 1 for k in range(s, s + least)}
        out.append((i, [x for k, x in enumerate(w) if k not in gone]))
    return sorted(out, key=str)


def test_repeats_stage_counts_words(spark):
    """Passages of 51 words go from the pipeline whatever their bytes; 50 words and what is beside a passage stay."""
    import corpus_pipeline

    r = random.Random(22)
    some = lambda n: [r.choice("aeiornst") + r.choice(["", "x", "Zu", "é"]) + str(r.randint(0, 99)) for _ in range(n)]
    rows = []
    for k, n in enumerate([51] * 20 + [50] * 10 + [60] * 10):
        passage = some(n)
        rows += [(10 * k + j, " ".join(some(r.randint(0, 80))) + r.choice([" ", "\n\n"]) + r.choice([" ", "\t "]).join(passage) + " " + " ".join(some(r.randint(0, 80)))) for j in range(2)]
    plain = some(70)
    rows += [(1000, " ".join(plain)), (1001, " ".join(plain).upper().replace("É", "é")), (1002, None), (1003, ""), (None, " ".join(some(90))), (1004, "w " * 120), (1005, " ".join(some(40)))]
    rows += [(1006, " ".join(some(55))), (1006, None)]
    rows += [(1007, rows[-2][1])]
    df = frame(spark, rows)
    for out in (suffixes.without_repeats(df, 51, "words"), corpus_pipeline.repeat_removal(spark, df, "")):
        assert out.columns == df.columns
        assert sorted(((x.doc_id, (x.text or "").encode().lower().split()) for x in out.collect()), key=str) == word_repeats(rows, 51)
    assert suffixes.without_repeats(df.limit(0), 51, "words").count() == 0


def test_two_stage_sorts_suffixes():
    r = np.random.default_rng(6)
    s = np.zeros((30, 32), np.uint16)
    s[:, :31] = r.integers(1, 4, (30, 31))
    s[:, 15] = 300 + r.integers(0, 3, 30)
    order = suffixes.two_stage(s)
    keys = [tuple(s[i // 32, i % 32 :]) for i in order]
    assert keys == sorted(keys) and sorted(order) == list(range(s.size))


def fingerprint(text):
    import re

    low = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    w = re.findall(rb"[^\x20\x09-\x0D]+", low)
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def test_op5_groups(spark):
    rows = texts(7)
    at = list(range(len(rows)))
    fp = [fingerprint(t) for _, t in rows]
    comp = union(at, [(a, b) for a in at for b in at if a < b and (fp[a] ^ fp[b]).bit_count() <= 4])
    least = {}
    for i in at:
        if rows[i][0] is not None:
            least[comp[i]] = min(least.get(comp[i], 10**9), rows[i][0])
    df = frame(spark, rows)
    got = sorted((r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(df).collect() if r.doc_id is not None)
    assert got == sorted((rows[i][0], fp[i], least[comp[i]]) for i in at if rows[i][0] is not None)
    one = simhash.one_of_each(df)
    assert one.columns == df.columns
    assert sorted(r.doc_id for r in one.collect()) == sorted(least.values())
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_op5_tree_finds_all_links():
    r = np.random.default_rng(8)
    x = np.unique(np.concatenate([r.integers(0, 2**63, 900, dtype=np.uint64), *[np.uint64(12345) ^ (np.uint64(1) << r.integers(0, 64, 200, dtype=np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, 200, dtype=np.uint64)) for _ in range(2)]]))
    want = union(range(len(x)), [(int(a), int(b)) for a in range(len(x)) for b in np.flatnonzero(np.bitwise_count(x[a] ^ x[:a]) <= 4)])
    assert simhash.tree_links(x).tolist() == [want[i] for i in range(len(x))]
    # several shards, among them single points
    first = np.array([0, 1, 2, 500, 501, 900])
    shard = np.searchsorted(first, np.arange(len(x)), side="right")
    want = union(range(len(x)), [(int(a), int(b)) for a in range(len(x)) for b in np.flatnonzero((np.bitwise_count(x[a] ^ x[:a]) <= 4) & (shard[:a] == shard[a]))])
    assert simhash.tree_links(x, first).tolist() == [want[i] for i in range(len(x))]
    # every node's edge is its distance to its parent, and siblings differ in their edges
    trees = simhash.BKTrees(x, first)
    child = np.flatnonzero(trees.parent >= 0)
    assert len(child) == len(x) - len(first)
    assert (np.bitwise_count(x[child] ^ x[trees.parent[child]]) == trees.edge[child]).all()
    assert len({(int(trees.parent[c]), int(trees.edge[c])) for c in child}) == len(child)


@pytest.mark.parametrize("shard", [20_000, 3])
def test_op5_shards_lose_no_link(spark, monkeypatch, shard):
    monkeypatch.setattr(simhash, "SHARD", shard)
    r = random.Random(9)
    x = [r.getrandbits(64) for _ in range(30)]
    for v in x[:20]:
        for _ in range(4):
            x.append(v ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 4))))
    x = sorted(set(x))
    signed = [v - 2**64 if v >= 2**63 else v for v in x]
    links = [(r.a, r.b) for r in simhash.fingerprint_links(spark.createDataFrame([(v,) for v in signed], "fp long")).collect()]
    want = union(signed, [(a, b) for a, u in zip(signed, x) for b, v in zip(signed, x) if a < b and (u ^ v).bit_count() <= 4])
    assert union(signed, links) == want


@pytest.mark.parametrize("small", [1_000_000, 0])
def test_components(spark, monkeypatch, small):
    monkeypatch.setattr(component_module, "SMALL", small)
    r = random.Random(10)
    links = [(r.randint(0, 200), r.randint(0, 200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 380)] + [(None, 3), (5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = union({x for p in links for x in p if x is not None}, [p for p in links if None not in p])
    assert got == {k: v for k, v in want.items() if k != v}
    nodes, least = min_labels(np.array([5, 7, 2]), np.array([7, 9, 3]))
    assert dict(zip(nodes.tolist(), least.tolist())) == {2: 2, 3: 2, 5: 5, 7: 5, 9: 5}


@pytest.mark.parametrize("block", [2048, 4])
def test_near_dedup_stage_takes_similar_documents(spark, monkeypatch, block):
    """Near copies of similarity 0.8 or more go whatever their fingerprints, and no document goes for a less similar one."""
    import corpus_pipeline

    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "CELLS", 100 * block)
    r = random.Random(18)
    words = ["".join(r.choice("aeiornst") for _ in range(r.randint(3, 8))) for _ in range(3000)]
    rows = []
    for n in (60, 150, 400):
        for share in (0.005, 0.01, 0.015, 0.02, 0.03, 0.05):
            for _ in range(8):
                w = [r.choice(words) for _ in range(n)]
                rows.append(" ".join(w))
                rows.append(" ".join(r.choice(words) if r.random() < share else x for x in w))
    # a group that shares most of its words but isn't similar, one of many near copies, a chain, texts without a word
    common = [r.choice(words) for _ in range(60)]
    rows += [" ".join(common + [r.choice(words) for _ in range(22)]) for _ in range(30)]
    rows += [" ".join([r.choice(words)] + common * 2) for _ in range(30)]
    chain = [r.choice(words) for _ in range(160)]
    rows += [" ".join(chain[i : i + 80]) for i in range(0, 80, 6)]
    rows += ["", None, " \n", "Two words", "two  WORDS", "two other"]
    shingles = [set(simhash.hashes((t or "").encode(), 5)) for t in rows]
    near = [(a, b) for a in range(len(rows)) for b in range(a) if len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b])]
    want = set(union(range(len(rows)), near).values())
    out = corpus_pipeline.near_dedup(spark, frame(spark, [*enumerate(rows), (3, rows[3]), (None, rows[5]), (None, "alone here"), (None, "alone here")]), "")
    got = Counter(x.doc_id for x in out.collect())
    assert got == Counter({**dict.fromkeys(want, 1), None: 1})
    assert out.columns == frame(spark, []).columns and len(want) < len(rows) - 60
    assert neardup.one_of_each(frame(spark, [])).count() == 0


def best_cost(places, penalty, size):
    best = {places[0]: 0}
    for j, p in enumerate(places[1:], 1):
        best[p] = min(best[q] + size - (p - q) + penalty[j] for q in places[:j] if p - q <= size)
    end = places[-1]
    return min(best[q] + packing.ANYWHERE * ((end - q).bit_count() - 1) for q in places[:-1] if end - q <= size)


def test_op6_cuts_are_optimal():
    r = random.Random(11)
    for _ in range(50):
        places = [0]
        while places[-1] < 300:
            places.append(places[-1] + r.randint(1, 12))
        penalty = [r.choice([0, 2, 12]) for _ in places]
        ends = packing.cuts(np.array(places), np.array(penalty), 32)
        cost, last = 0, 0
        for e in ends[:-1]:
            assert e - last <= 32
            cost, last = cost + 32 - (e - last) + penalty[places.index(e)], e
        cost += packing.ANYWHERE * ((ends[-1] - last).bit_count() - 1)
        assert ends[-1] - last <= 32 and ends[-1] == places[-1] and cost == best_cost(places, penalty, 32)


def test_op6_cuts_with_any_penalties():
    r = random.Random(12)
    for k in range(60):
        size, far = r.choice([(32, 32), (64, 9), (16, 3)])
        places = [0]
        while places[-1] < 400:
            places.append(places[-1] + r.randint(1, far))
        # few free places, many, all, none
        penalty = [0 if r.random() < (0.02, 0.5, 1, 0)[k % 4] else r.choice([1, 2, 12, 40]) for _ in places]
        ends = packing.cuts(np.array(places), np.array(penalty), size)
        cost = sum(size - (b - a) + penalty[places.index(b)] for a, b in zip([0, *ends], ends[:-1]))
        last = ends[-1] - (ends[-2] if len(ends) > 1 else 0)
        assert all(b - a <= size for a, b in zip([0, *ends], ends)) and ends[-1] == places[-1]
        assert cost + packing.ANYWHERE * (last.bit_count() - 1) == best_cost(places, penalty, size)
    assert packing.cuts(np.array([0]), np.array([0]), 32) == []


def test_op6_words_are_learned_once(monkeypatch):
    coder, learned = tokens.Encoder(WORD, packing.WORDS), []
    apart = tokens.Encoder._apart
    monkeypatch.setattr(tokens.Encoder, "_apart", lambda self, words: learned.append(len(words)) or apart(self, words))
    letters = np.array(list("abcdefghij"))
    rows = [" ".join("".join(letters[[int(d) for d in f"{n:06d}"]]) for n in range(low, low + 20_000)) for low in range(0, 200_000, 20_000)]
    first = [coder.encode([x])[0] for x in rows]
    again = [coder.encode([x])[0] for x in rows]
    assert sum(learned) == 200_000 and all((a == b).all() for a, b in zip(first, again))
    assert first[3].tolist() == Tokenizer.from_file(WORD).encode(rows[3], add_special_tokens=False).ids


def test_op6_pieces(spark):
    rows = texts(12)
    t = Tokenizer.from_file(WORD)
    got = packing.pack(frame(spark, rows), WORD, segment=3000).collect()
    ids = [t.encode(x or "", add_special_tokens=False).ids + [1] for _, x in rows]
    assert Counter((r.doc_id, r.doc_tokens) for r in got if r.start == 0) == Counter((i, len(x)) for (i, _), x in zip(rows, ids))
    known = {(i, a, n): zlib.crc32(np.array(x[a : a + n], "<u4").tobytes()) for (i, _), x in zip(rows, ids) for a in range(len(x)) for n in [r.length for r in got if r.doc_id == i and r.start == a]}
    assert all(known[r.doc_id, r.start, r.length] == r.ids_crc32 for r in got if r.doc_id is not None)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    padding = 0
    for parts in sequences.values():
        end = 0
        for a, n in sorted(parts):
            assert a == end
            end += n
        assert end <= 2048
        padding += 0 if end & (end - 1) == 0 else 2048 - end
    assert sum(r.length for r in got) == sum(map(len, ids)) and padding < 0.02 * sum(map(len, ids))
    assert packing.pack(frame(spark, []), WORD).count() == 0


def test_op7_grades(spark):
    r = random.Random(13)
    words = ["".join(r.choice("aeiornst") for _ in range(r.randint(3, 8))) for _ in range(400)]
    bad = ["zugbad", "zugbads", "vileword"]
    docs, labels = [], []
    for i in range(400):
        w = [r.choice(words) for _ in range(r.randint(5, 60))]
        if toxic := i % 5 == 0:
            w += [r.choice(bad) for _ in range(r.randint(1, 4))]
        docs.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    docs += [(500, None), (501, ""), (502, "some vileword here"), (None, "zugbad zugbad")]
    labels += [(7, 1), (None, 1), (501, None), (502, 9)]
    df, lab = frame(spark, docs), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(df, lab)
    assert (np.diff(model.cuts) >= 0).all()
    got = {x.doc_id: x for x in toxicity.severity(df, model).collect()}
    assert np.mean([got[i].toxic == (i % 5 == 0) for i in range(400)]) > 0.97
    assert got[502].toxic and not got[500].toxic and 0 <= got[501].severity <= 3
    assert toxicity.severity(df.limit(0), model).count() == 0
    assert not any(x.toxic for x in toxicity.severity(df, toxicity.train(df, lab.limit(0))).collect())


def test_op7_held_out(spark):
    """Documents whose labels the fit didn't see: toxic ones rank above the others, and few clean ones are taken for toxic."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = toxicity.train(docs, labels.where(~out))
    held = docs.where(out).join(labels.select("doc_id", F.col("toxic").alias("truth")), "doc_id")
    truth = {r.doc_id: r.truth for r in held.collect()}
    got = toxicity.severity(held.drop("truth", "toxic"), model).collect()
    p, y = np.array([r.p_toxic for r in got]), np.array([truth[r.doc_id] == 1 for r in got])
    above = p[y][:, None] - p[~y][None]
    assert len(got) > 500 and np.mean((above > 0) + 0.5 * (above == 0)) > 0.95
    assert np.mean(p[y] >= 0.5) > 0.85 and np.mean(p[~y] >= 0.5) < 0.01


def test_op7_fit_reaches_the_optimum():
    """The proximal steps against a pattern search on the same penalised likelihood, in few dimensions."""
    r = np.random.default_rng(33)
    n, names = 400, 3
    has = r.random((n, names)) < 0.4
    score = has @ np.array([3.0, 2.0, 2.5]) + r.logistic(size=n)
    grade = np.digitize(score, [4.0, 6.0, 8.0])
    found = np.concatenate([np.flatnonzero(x) for x in has])
    first = np.concatenate([[0], np.cumsum(has.sum(axis=1))])
    model = toxicity.fit(found, first, grade, 4, rounds=3000, l1=1e-3)
    kept = np.flatnonzero(toxicity.marks(found, first, grade > 0))

    def objective(p):
        w, cuts = p[: len(kept)], p[len(kept) :]
        return toxicity.loss(has[:, kept] @ w, cuts, grade) + 1e-3 * np.abs(w).sum() if (np.diff(cuts) > 0).all() else np.inf

    p = np.concatenate([np.zeros(len(kept)), [1.0, 2.0, 3.0]])
    best, step = objective(p), 1.0
    while step > 1e-5:
        tries = [p + step * d for i in range(len(p)) for d in (np.eye(len(p))[i], -np.eye(len(p))[i])]
        values = [objective(t) for t in tries]
        if min(values) < best:
            p, best = tries[int(np.argmin(values))], min(values)
        else:
            step /= 2
    assert len(kept) >= 2 and objective(np.concatenate([model.weights[kept], model.cuts])) < best + 1e-3
    assert toxicity.grades_of(np.array([True, True, True, True, False]), np.array([0, 1, 2, 9, 9])).tolist() == [1, 1, 2, 3, 0]


def test_op8_gradients_and_temperature():
    r = np.random.default_rng(34)
    x, y = r.standard_normal((300, 5)), (r.random(300) < 0.5).astype(float)
    y[x[:, 0] + x[:, 1] > 0.3] = 1
    net = quality.Network(np.zeros(5), np.ones(5), r.standard_normal((5, 4)), r.standard_normal(4), r.standard_normal(4), 0.1)

    def loss():
        z = net.logit(x)
        return np.mean(np.logaddexp(0, np.where(y == 1, -z, z))) + 5e-5 * (np.sum(net.w1**2) + np.sum(net.w2**2))

    for name, got in zip(("w1", "b1", "w2"), quality.gradients(net, x, y)):
        p = getattr(net, name)
        for i in np.ndindex(p.shape):
            kept = p[i]
            p[i] = kept + 1e-6
            up = loss()
            p[i] = kept - 1e-6
            assert abs((up - loss()) / 2e-6 - got[i]) < 1e-6
            p[i] = kept
    net = quality.fit(x, y)
    held = np.random.default_rng(5)
    held.standard_normal((5, quality.HIDDEN)), held.standard_normal(quality.HIDDEN)
    rows = held.permutation(300)[:60]
    mean = lambda t: np.mean(np.logaddexp(0, np.where(y[rows] == 1, -1, 1) * net.logit(x[rows]) / t))
    assert mean(net.temperature) <= min(mean(t) for t in np.linspace(0.3, 7, 80)) + 1e-3
    assert np.mean((net.score(x) > 0.5) == y) > 0.7


def test_labelled_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr("panelforge.llm.labelled.MOST_BYTES", 1000)
    monkeypatch.setattr("panelforge.llm.labelled.LONGEST", 300)
    docs = frame(spark, [(i, "x" * (400 if i % 7 == 0 else 100)) for i in range(60)] + [(1, None)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, toxic int")
    rows = labelled(docs, labels, "toxic", 40).collect()
    assert 5 <= len(rows) <= 10 and all(r.doc_id % 7 and r.label == r.doc_id % 2 for r in rows)


def test_op8_scores(spark):
    r = random.Random(14)
    words = ["".join(r.choice("aeiornst") for _ in range(r.randint(3, 8))) for _ in range(300)]
    docs, labels = [], []
    for i in range(500):
        w = [r.choice(words) for _ in range(r.randint(10, 80))]
        junk = i % 4 == 0
        docs.append((i, " | ".join(w) if junk and i % 8 else " ".join(x.upper() + "!!" for x in w) if junk else " ".join(w) + "."))
        labels.append((i, int(not junk)))
    docs += [(600, None), (601, ""), (None, "a b")]
    df, lab = frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int")
    model = quality.train(df, lab)
    got = {x.doc_id: x for x in quality.scores(df, model).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in [*range(500), 600, 601])
    held = [i for i in range(500) if got[i].held_out]
    assert np.mean([got[i].predicted == (i % 4 != 0) for i in held]) > 0.97
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) for x in got.values())
    assert quality.accepted(df, model).columns == df.columns
    assert quality.scores(df.limit(0), model).count() == 0
    assert {x.score for x in quality.scores(df, quality.train(df, lab.limit(0))).collect()} == {0.5}


def test_op9_passages(spark):
    r = random.Random(15)
    words = ["".join(r.choice("aeiornst") for _ in range(r.randint(3, 8))) for _ in range(2000)]
    item = [[r.choice(words) for _ in range(n)] for n in (40, 25, 14, 8)]
    noise = lambda n: [r.choice(words) for _ in range(n)]
    changed = list(item[0])
    for k in (5, 17, 29):
        changed[k] = "xxxx"
    docs = [(1, noise(50) + item[0] + noise(50)), (2, noise(9) + [w.upper() + "," for w in item[1]]), (3, changed), (4, noise(300)), (5, item[0][:20] + noise(20)), (6, item[2] + item[3]), (7, item[0][:6] + noise(30)), (9, item[1]), (9, item[1])]
    df = frame(spark, [*((i, " ".join(w)) for i, w in docs), (10, None), (11, ""), (None, " ".join(item[0])), (12, "the " * 5000)])
    bench = spark.createDataFrame([(k, " ".join(w), 0) for k, w in enumerate(item)] + [(50, None, 0), (None, "a b", 0), (51, "short", 0), (0, " ".join(item[0]), 0)], "item_id long, text string, h int")
    got = Counter((x.doc_id, x.item_id) for x in contamination.overlaps(df, bench).collect())
    assert got == Counter([(1, 0), (2, 1), (3, 0), (5, 0), (6, 2), (6, 3), (9, 1), (9, 1), (None, 0)])
    clean = contamination.without_overlaps(df, bench)
    assert clean.columns == df.columns and sorted(x.doc_id for x in clean.collect()) == [4, 7, 10, 11, 12]
    assert contamination.overlaps(df, bench.limit(0)).count() == 0 and contamination.overlaps(df.limit(0), bench).count() == 0
    assert contamination.without_overlaps(df, bench.limit(0)).count() == df.count()


def test_op9_stretch_has_the_most_equal_words():
    r = random.Random(20)
    for _ in range(400):
        same = np.array([r.random() < 0.8 for _ in range(r.randint(0, 40))], bool)
        equal, start, end = contamination.stretch(same)
        assert equal == max([int(same[a:b].sum()) for a in range(len(same)) for b in range(a + 1, len(same) + 1) if 5 * same[a:b].sum() >= 4 * (b - a)], default=0)
        assert equal == same[start:end].sum() and 5 * equal >= 4 * (end - start)


def test_op9_spread_replacements(spark):
    """Items of 15 to 60 words with replaced words all over them are found where so many words are equal."""
    r = random.Random(21)
    words = ["".join(r.choice("aeiornst") for _ in range(r.randint(3, 8))) for _ in range(4000)]
    patterns = [(15, (6, 11)), (15, (4, 10)), (26, (6, 11, 16, 21)), (30, (5, 11, 17, 23, 29)), (60, tuple(range(4, 60, 5))), (22, (7, 14)), (20, (4, 9, 14, 19)), (20, (3, 7, 11, 15, 19)), (15, (1, 5, 8, 12))]
    items, docs = [], []
    for n, replaced in patterns:
        items.append([r.choice(words) for _ in range(n)])
        docs.append([r.choice(words) for _ in range(30)] + ["xxxx" if k in replaced else w for k, w in enumerate(items[-1])] + [r.choice(words) for _ in range(30)])
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    found = {(x.doc_id, x.item_id): x.equal_words for x in contamination.overlaps(frame(spark, [(k, " ".join(w)) for k, w in enumerate(docs)]), bench).collect()}
    assert found == {(k, k): n for k, n in enumerate([13, 13, 22, 25, 48, 20, 16])}


@pytest.mark.parametrize("hits", [1 << 20, 7])
def test_op9_equals_a_search_of_all_diagonals(spark, monkeypatch, hits):
    """Against every diagonal that some mask hits, with words that repeat in documents and items."""
    monkeypatch.setattr(contamination, "HITS", hits)
    r = random.Random(32)
    words = ["w" + str(k) for k in range(9)]
    item = [[r.choice(words) for _ in range(r.randint(5, 40))] for _ in range(12)] + [["a"] * 50, ["a", "b"] * 20, ["a"] * 12]
    docs = [[r.choice(words) for _ in range(r.randint(0, 80))] for _ in range(30)] + [["a"] * 300, ["b", "a"] * 90, ["a"] * 20 + ["x"] * 9 + ["a", "b"] * 10]
    docs += [[w if r.random() < 0.9 else "y" for w in d] for d in item[:6]]

    def stretch(x, y, shift):
        same = [0 <= k + shift < len(y) and w == y[k + shift] for k, w in enumerate(x)]
        inside = [k for k in range(len(x)) if 0 <= k + shift < len(y)]
        total = [0]
        for k in inside:
            total.append(total[-1] + same[k])
        return max((total[j] - total[i] for i in range(len(inside)) for j in range(i + 1, len(inside) + 1) if 5 * (total[j] - total[i]) >= 4 * (j - i)), default=0)

    def hit(x, y, shift):
        return any(all(x[k + i] == y[k + i + shift] for i, c in enumerate(m) if c == "1") for m in contamination.MASKS for k in range(len(x) - len(m) + 1) if 0 <= k + shift <= len(y) - len(m))

    want = {}
    for d, y in enumerate(docs):
        for b, x in enumerate(item):
            n = max((stretch(x, y, s) for s in range(-len(x), len(y)) if hit(x, y, s)), default=0)
            if n >= min(13, 0.8 * len(x)):
                want[d, b] = n
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(item)], "item_id long, text string")
    found = contamination.overlaps(frame(spark, [(k, " ".join(w)) for k, w in enumerate(docs)]), bench).collect()
    assert {(x.doc_id, x.item_id): x.equal_words for x in found} == want and len(want) > 10
    long = frame(spark, [(1, "the " * 100_000), (2, "of the " * 50_000)])
    same = spark.createDataFrame([(1, "the " * 5000), (2, "the of " * 2000)], "item_id long, text string")
    assert {(x.doc_id, x.item_id, x.equal_words) for x in contamination.overlaps(long, same).collect()} == {(1, 1, 5000), (2, 2, 4000)}


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_op10_round_trip(spark, encoding):
    rows = texts(16)
    t = Tokenizer.from_file(BYTE)
    path = scratch(spark, "tokens")
    tokenfile.write_tokens(frame(spark, rows), path, BYTE, encoding=encoding)
    want, start = [], 0
    for i, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = t.encode(x or "", add_special_tokens=False).ids + [0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, tokenfile.checksums(spark, path).collect()), key=lambda r: r[1]) == want
    assert sorted(map(tuple, tokenfile.read_metadata(spark, path).collect()), key=lambda r: r[1]) == [w[:3] for w in want]
    assert {r.doc_id for r in tokenfile.read_ids(spark, path, 3, 6).collect()} == {3, 4, 5}
    tokenfile.write_tokens(frame(spark, []), path + "e", BYTE)
    assert tokenfile.checksums(spark, path + "e").count() == 0


def test_pipeline_stages(spark):
    """Each stage on a fixture: rejects, copies, repeats and benchmark passages go, clean documents stay."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = scratch(spark, f"stage{k}")
        stage(spark, docs, sf).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        assert docs.count() > 0
        if k < 4:
            assert docs.columns == columns
            assert docs.join(before.select("doc_id"), "doc_id", "left_anti").count() == 0
    assert docs.select("doc_id").distinct().count() == before.count()


SF = "/root/testdata/sf0.001"


def registered(number):
    import __spark_entry__

    return next(f for n, f in __spark_entry__.queries().items() if n.startswith(f"op{number}_"))


def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def test_registered_token_queries(spark):
    """op1, op6 and op10 over whole tables, against the tokenizers library."""
    rows = documents(spark)
    for number, path, end in ((1, BYTE, []), (6, WORD, [1]), (10, BYTE, [0])):
        t = Tokenizer.from_file(path)
        ids = {i: t.encode(x or "", add_special_tokens=False).ids + end for i, x in rows}
        got = registered(number)(spark, SF).collect()
        if number == 1:
            assert {r.n_tokens: r.docs for r in got} == Counter(map(len, ids.values()))
        elif number == 6:
            parts = Counter()
            for r in got:
                parts[r.doc_id] += r.length
                assert zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
            assert parts == Counter({i: len(x) for i, x in ids.items()})
        else:
            start = 0
            for r in sorted(got, key=lambda r: r.doc_id):
                assert tuple(r)[:4] == (r.doc_id, start, len(ids[r.doc_id]), zlib.crc32(np.array(ids[r.doc_id], "<u4").tobytes()))
                start += len(ids[r.doc_id])


def test_registered_similarity_queries(spark):
    """op3, op4 and op5 over whole tables, against brute force."""
    rows = documents(spark)
    got = registered(4)(spark, SF).collect()
    assert sorted((tuple(x)[:5] for x in got), key=str) == repeats(rows, 400)
    fp = {i: fingerprint(x) for i, x in rows}
    ids = sorted(fp)
    bits = np.array([fp[i] for i in ids], np.uint64)
    near = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= 4
    comp = union(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near)) if a < b])
    assert sorted(map(tuple, registered(5)(spark, SF).select("doc_id", "fingerprint", "component_id").collect())) == sorted((i, f"{fp[i]:016x}", comp[i]) for i in ids)
    v = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    ids = sorted(v)
    unit = np.stack([v[i] / np.linalg.norm(v[i]) for i in ids])
    hit = unit @ unit.T >= 0.9
    np.fill_diagonal(hit, False)
    comp = union(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(hit)) if a < b])
    assert sorted(map(tuple, registered(3)(spark, SF).collect())) == [(i, int(hit[k].sum()), comp[i], comp[i] == i) for k, i in enumerate(ids)]


def test_registered_classifiers(spark):
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    toxic = {r.doc_id: r for r in registered(7)(spark, SF).collect()}
    good = {r.doc_id: r for r in registered(8)(spark, SF).collect()}
    ids = {i for i, _ in documents(spark)}
    assert set(toxic) == set(good) == ids
    assert np.mean([toxic[i].toxic == (r.toxic == 1) for i, r in labels.items() if i in ids]) > 0.85
    assert all(good[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in ids)
    found = registered(9)(spark, SF).collect()
    assert all(r.equal_words >= min(13, 0.8 * r.item_words) for r in found)


def test_very_long_texts(spark):
    """A text of 4 MB through every operator on texts, with values where they are known."""
    r = random.Random(35)
    words = ["".join(r.choice("aeiornst") for _ in range(r.randint(2, 8))) for _ in range(5000)]
    item = [r.choice(words) for _ in range(30)]
    big = " ".join(r.choice(words) for _ in range(700_000)) + " " + " ".join(item)
    rows = [(1, big), (2, "short text"), (3, None)]
    df = frame(spark, rows)
    t = Tokenizer.from_file(BYTE)
    n = {i: len(t.encode(x or "", add_special_tokens=False).ids) for i, x in rows}
    assert {x.n_tokens: x.docs for x in counts.length_histogram(df, BYTE).collect()} == Counter(n.values())
    path = scratch(spark, "long")
    tokenfile.write_tokens(df, path, BYTE)
    assert {x.doc_id: x.n_tokens for x in tokenfile.checksums(spark, path).collect()} == {i: k + 1 for i, k in n.items()}
    pieces = packing.pack(df, WORD).collect()
    long = Tokenizer.from_file(WORD).encode(big, add_special_tokens=False).ids + [1]
    assert sum(p.length for p in pieces if p.doc_id == 1) == len(long) and max(p.length for p in pieces) <= 2048
    assert {x.doc_id: x.fp % 2**64 for x in simhash.fingerprints(df).collect()} == {i: fingerprint(x) for i, x in rows}
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    assert [(x.doc_id, x.item_id, x.equal_words) for x in contamination.overlaps(df, bench).collect()] == [(1, 7, 30)]
    assert sorted(x.doc_id for x in neardup.one_of_each(df).collect()) == [1, 2, 3]
    pages = spark.createDataFrame([(i, "u", x) for i, x in rows], "page_id long, url string, html string")
    warc.write_archive(pages, path + "w")
    assert {x.page_id: x.payload_digest for x in warc.records_summary(warc.read_records(spark, path + "w")).collect()} == {i: hashlib.sha256((x or "").encode()).hexdigest() for i, x in rows}
    few = frame(spark, [(10 + i, " ".join(r.choice(words) for _ in range(20)) + (" !!" if i % 2 else "")) for i in range(60)] + rows)
    labels = spark.createDataFrame([(10 + i, i % 2, i % 2) for i in range(60)] + [(1, 1, 0)], "doc_id long, quality int, toxic int")
    scored = {x.doc_id: x for x in quality.scores(few, quality.train(few, labels)).collect()}
    assert 0 <= scored[1].score <= 1
    assert {x.doc_id for x in toxicity.severity(few, toxicity.train(few, labels)).collect()} == {x.doc_id for x in few.collect()}


def test_pipeline_with_nulls_and_empty_tables(spark, tmp_path):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(i, f"words number {i} and some more of them, all of them plain {i * 7}", "en", "a", 10) for i in range(30)]
    rows += [(100, None, None, None, None), (101, "", "en", "a", 0), (None, "a text without an id", None, "a", 3), (3, rows[3][1], "en", "a", 10), (102, rows[4][1], "en", "b", 10)]
    for name, part in (("some", rows), ("none", [])):
        d = f"file://{tmp_path}/{name}"
        spark.createDataFrame(part, schema).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(i, 1, 0) for i in range(20)] if part else [], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        out = corpus_pipeline.run(spark, d).collect()
        ids = {r.doc_id for r in out}
        assert ids <= {x[0] for x in part}
        # one class of labels accepts all; of the copies the smaller id stays, of the texts without a word one
        assert not part or ({*range(30)} <= ids and 102 not in ids and len(ids & {100, 101}) == 1)


def test_near_copies_come_from_trees(monkeypatch):
    """a shard's pairs within the radius are those that its BK-tree finds, copies and small shards included."""
    r = np.random.default_rng(4)
    base = r.integers(0, 2**63, 40, dtype=np.uint64)
    points = np.concatenate([base, base[:5], base ^ r.integers(0, 2**20, 40, dtype=np.uint64)])
    asked = np.concatenate([points[::3], r.integers(0, 2**63, 10, dtype=np.uint64)])
    searched = []
    within = simhash.BKTrees.within
    monkeypatch.setattr(simhash.BKTrees, "within", lambda self, *a: searched.append(1) or within(self, *a))
    monkeypatch.setattr(neardup, "ASKED", 7)
    for radius in (0, 4, 20, 64):
        want = np.bitwise_count(points[None, :] ^ asked[:, None]) <= radius
        assert (neardup.tree_pairs(points, asked, radius) == want).all()
        assert (neardup.tree_pairs(points[:1], asked, radius) == want[:, :1]).all()
    assert searched


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_new_words_are_encoded_in_a_row(path, monkeypatch):
    """op10: of the byte-level file's new words only those without a space before them are encoded one by one; ids stay the library's."""
    r = random.Random(10)
    parts = ["foo", "Éa", "don't", "'s", "123", "$$$", "a.b", "x,", "y.", "...", "ñ", "<", "|>", "\n", "\t", "\r", "  ", " ", "«q»", "中", "\x01", "\xa0", "-", "it's", "\x85"]
    texts = ["", None, " ", "\n", ".", ". ", " a", "a ", "a\n", ".\n", "\na", "a. b.", "a.\n"]
    texts += ["".join(r.choice(parts) + r.choice(["", " ", " ", " "]) for _ in range(r.randint(1, 12))) for _ in range(1500)]
    texts += [" ".join("".join(r.choice("aeiousßÀ") for _ in range(9)) for _ in range(40)) + ", end." for _ in range(60)]
    t, coder, alone = Tokenizer.from_file(path), tokens.Encoder(path, most_words=900), []
    apart = tokens.Encoder._apart
    monkeypatch.setattr(tokens.Encoder, "_apart", lambda self, words: alone.extend(words) or apart(self, words))
    for low in range(0, len(texts), 97):
        ids, at = coder.encode(texts[low : low + 97])
        got = [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])]
        assert got == [t.encode(x or "", add_special_tokens=False).ids for x in texts[low : low + 97]]
    assert path == WORD or all(not w or w[0] in "\n\r\t\x01" for w in alone)
