"""Queries of the subpackage against their SQL, and the pipeline's stages against brute force."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from ranklume.llm import decontaminate, fingerprint, license_scan, queries

from ..conftest import SF, normal
from .test_operators import ascii_lower, linked_by_pairs


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(spark, duck, name):
    ours = queries.queries()[name](spark, SF).toPandas()
    theirs = duck.execute(queries.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns) and normal(ours) == normal(theirs)


def test_every_operator_has_its_query():
    assert [q.split("_")[0] for q in queries.queries()] == [f"op{n}" for n in range(1, 11)]


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name == "best_fit_packing":
            assert {r["doc_id"] for r in out.select("doc_id").distinct().collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}
            break
        assert out.columns == corpus_pipeline.COLUMNS
        rows = {r["doc_id"]: r for r in out.collect()}
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "simhash_near_dedup":
            assert set(rows) == kept_of(before)
        elif name == "secret_scan":
            assert set(rows) == set(before) and all(r["n_chars"] == len(r["text"]) for r in rows.values())
        else:
            assert set(rows) <= set(before) and len(rows) > 0.5 * len(before)
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "benchmark_decontamination", "secret_scan", "best_fit_packing"]


def kept_of(texts):
    """The smallest doc_id of each group of texts that a chain of similarities of 0.8 links."""
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in texts.items() for w in [t.encode().lower().split()]}
    root = {i: i for i in texts}

    def up(x):
        while root[x] != x:
            x = root[x]
        return x

    order = sorted(texts)
    for n, a in enumerate(order):
        for b in order[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and both / len(sets[a] | sets[b]) >= 0.8:
                x, y = sorted((up(a), up(b)))
                root[y] = x
    return {i for i in texts if up(i) == i}


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def documents(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def test_op1_query(spark):
    texts, got = documents(spark), {r["doc_id"]: r for r in queries.op1_license_scan(spark, SF).collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text))
        places = [(k, label) for phrase, label in license_scan.BASE for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        r, starts = got[i], [p for p, _ in places]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), len(places), min(starts, default=None), max(starts, default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places})) and set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_op2_query(spark):
    texts, got = documents(spark), queries.op2_best_fit_packing(spark, SF).toPandas()
    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    for i, text in texts.items():
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 0], "<u4")
        own = got[got.doc_id == i].sort_values("piece")
        starts = list(range(0, len(ids), 2048))
        assert own.start.tolist() == starts and own.length.tolist() == [len(ids[a : a + 2048]) for a in starts]
        assert own.ids_crc32.tolist() == [zlib.crc32(ids[a : a + 2048].tobytes()) for a in starts]
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == [0, *own.length.cumsum().tolist()[:-1]] and own.length.sum() <= 2048
    assert got.sequence_id.nunique() <= -(-int(got.length.sum()) // 2048) + 1


@pytest.mark.parametrize("query,threshold", [("op3_quality_classifier", 0.3), ("op6_toxicity", 0.5)])
def test_scoring_queries(spark, query, threshold):
    texts, got = documents(spark), {r["doc_id"]: r for r in queries.queries()[query](spark, SF).collect()}
    assert set(got) == set(texts)
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= threshold) and 0 <= r["score"] <= 1
    scores: dict[str, set] = {}
    for i, r in got.items():
        scores.setdefault(texts[i], set()).add(r["score"])
    assert all(len(x) == 1 for x in scores.values())  # nothing but the text counts


def slow_fingerprint(text):
    """A fingerprint byte by byte, as its docstring says it."""
    raw, mask = text.encode(), 0xFFFFFFFF

    def mixed(k):
        h = 0
        for back in range(min(fingerprint.WINDOW, k + 1)):
            h = (h + (raw[k - back] + 1) * pow(0x01000193, back, 1 << 32)) & mask
        h ^= h >> 15
        h = h * 0x2C1B3C6D & mask
        return h ^ h >> 12

    rolled = [mixed(k) for k in range(len(raw))]

    def signature(size):
        out, start = "", 0
        for k in range(len(raw)):
            if rolled[k] % size == size - 1 or k + 1 == len(raw):
                out += fingerprint.ALPHABET[zlib.crc32(raw[start : k + 1]) & 63]
                start = k + 1
        return out

    size = fingerprint.SMALLEST
    while size * fingerprint.PIECES < len(raw):
        size *= 2
    while size > fingerprint.SMALLEST and sum(h % size == size - 1 for h in rolled) < fingerprint.PIECES // 2:
        size //= 2
    return f"{size}:{signature(size)}:{signature(2 * size)}"


def test_op5_query(spark):
    texts, got = documents(spark), {r["doc_id"]: r for r in queries.op5_document_fingerprints(spark, SF).collect()}
    order = sorted(texts)
    assert sorted(got) == order
    for i, j in zip(order, order[1:] + order[:1], strict=True):
        a, b, r = texts[i], texts[j], got[i]
        new = a[: len(a) - len(a) // 4] + b[: len(a) // 4]
        assert (r["n_chars"], r["edited_sha256"]) == (len(a), hashlib.sha256(new.encode()).hexdigest())
        if len(a) < 4000:
            assert r["fingerprint"] == slow_fingerprint(a) and r["edited_fingerprint"] == slow_fingerprint(new)
        assert r["near_edited"] == fingerprint.likeness(r["fingerprint"], r["edited_fingerprint"]) and r["near_next"] == fingerprint.likeness(r["fingerprint"], got[j]["fingerprint"])


def test_op7_query(spark):
    texts, got = documents(spark), {r["doc_id"]: r for r in queries.op7_secret_scan(spark, SF).collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        spans = linked_by_pairs(text)
        base = [x for x in spans.split(",") if x.split(":")[0] in ("assign", "access", "hex")]
        counts = [sum(x.startswith(k) for x in base) for k in ("assign", "access", "hex")]
        assert got[i]["spans"] == spans and [got[i][f"n_{k}"] for k in ("assign", "access", "hex")] == counts
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()


def test_op8_query(spark):
    texts, got = documents(spark), {r["doc_id"]: r for r in queries.op8_simhash_near_dedup(spark, SF).collect()}
    prints = {}
    for i, text in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text))
        parts = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
        h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    root = {i: i for i in prints}
    for a, b in itertools.combinations(sorted(prints), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 2 and root[a] != root[b]:
            low, high = sorted((root[a], root[b]))
            root = {i: low if r == high else r for i, r in root.items()}
    assert {i: r["component_id"] for i, r in got.items()} == root


def test_op10_query(spark):
    """Against every passage scored with every item, without an index."""
    texts = documents(spark)
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    found = decontaminate.index(sorted(items.items()), 80)
    weight: dict[int, dict[str, float]] = {k: {} for k in range(len(found.owners))}
    for word, t in found.terms.items():
        for cut, w in zip(*found.postings[t], strict=True):
            weight[cut][word] = w
    want = set()
    for i, text in texts.items():
        said = decontaminate.words(text)
        for at in range(0, max(1, (len(said) - 1) // 80) * 80, 80):
            own = set(said[at : at + 160])
            for cut, terms in weight.items():
                if terms and sum(w for x, w in terms.items() if x in own) >= 0.5:
                    k = found.owners[cut]
                    near = said[max(0, at - found.lengths[k] - 5) : at + 160 + found.lengths[k] + 5]
                    q, w = found.questions[k], found.answers[k]
                    hits = decontaminate.overlap(q, near), decontaminate.overlap(w, near)
                    if sum(hits) >= 0.8 * (len(q) + len(w)) and hits[0] >= 0.5 * len(q) and hits[1] >= 0.5 * len(w):
                        want.add((i, found.items[k]))
    got = {(r["doc_id"], r["item_id"]) for r in queries.op10_benchmark_decontamination(spark, SF).collect()}
    assert got == want and want


def test_pipeline_bears_odd_rows(spark, tmp_path):
    text = " ".join(f"w{k}" for k in range(80))
    docs = [(1, text), (2, text + " end"), (2, text + " end"), (None, "login=bob Qx7vT9mPq2Lr8sWz4Kb1"), (3, None), (4, ""), (5, "password = abcdefgh")]
    for name, rows in (("odd", docs), ("none", [])):
        frame = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
        for table in ("labels", "benchmark"):
            spark.read.parquet(f"{SF}/{table}.parquet").limit(0 if name == "none" else 10**6).write.parquet(f"{tmp_path}/{name}/{table}.parquet")
        out = frame
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, out, f"{tmp_path}/{name}")
            assert out.columns == frame.columns
        kept = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
        if rows:
            assert (1, text) in kept and not any(i == 2 for i, _ in kept) and (3, None) in kept and not any(i == 4 for i, _ in kept) and (5, "[SECRET]") in kept and (None, "[SECRET] [SECRET]") in kept
        packed = corpus_pipeline.STAGES[-1][1](spark, out, f"{tmp_path}/{name}")
        assert packed.count() == len(kept)
