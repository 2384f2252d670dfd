import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vocalith.llm import bpe, jaccard, packing, pii, queries, simhash, token_counts, toxicity
from vocalith.llm.shingles import shingle_sets
from vocalith.llm.tokens import encode, rank_file

ODD_TEXTS = ["", "hello <|endoftext|> x", "a<|endoftext|>b<|endoftext|>", "word <|endoftext|> " * 5000, "it's  fine\r\n\t ok ", "é́　 x 12٣½", "a" * 3000, " " * 9000 + "b", "word " * 30_000, "\u2003\n\n\n  x", "don't you'LL 7777777 !!??"]


@pytest.fixture(scope="module")
def tk(bpe_json):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe_json[0])


@pytest.fixture(scope="module")
def reference_encoding(bpe_ranks):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=bpe_ranks[1], mergeable_ranks=rank_file(bpe_ranks[0]), special_tokens={})


# 1, 10: encoded lengths


@pytest.mark.parametrize("text", ODD_TEXTS)
def test_ids_equal_tokenizers(text, tk, bpe_json):
    assert encode(text, *bpe_json).tolist() == tk.encode(text, add_special_tokens=False).ids


def plain_best_fit(lengths, capacity):
    room = []
    for n in sorted(lengths, reverse=True):
        fit = [(r, i) for i, r in enumerate(room) if r >= n]
        if fit:
            room[min(fit)[1]] -= n
        else:
            room.append(capacity - n)
    return sorted(room)


@pytest.mark.parametrize("seed", range(12))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([8, 20, 64])
    lengths = [rng.choice([rng.randint(1, capacity), rng.randint(1, 5), 3]) for _ in range(rng.randrange(1, 150))]
    rows = packing.plan(dict(Counter(lengths)), capacity)
    fill = defaultdict(list)
    seen = Counter()
    for n, rank, k, first, per, offset in rows.tolist():
        for r in range(rank, rank + k):
            fill[first + (r - rank) // per].append((offset + (r - rank) % per * n, n))
            seen[n] += 1
    assert seen == Counter(lengths)
    for spans in fill.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= capacity
    assert sorted(capacity - sum(n for _, n in s) for s in fill.values()) == plain_best_fit(lengths, capacity)


def check_packed(rows, docs, tk, capacity=2048):
    per_row = defaultdict(list)
    for r in rows:
        per_row[r["doc_id"]].append(r)
    for doc_id, texts in docs.items():
        want = Counter()
        for text in texts:
            ids = [*tk.encode(text or "", add_special_tokens=False).ids, 0]
            for i, (s, n) in enumerate(packing.cut(len(ids), capacity)):
                want[i, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())] += 1
        assert Counter((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in per_row[doc_id]) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in bins.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= capacity
    assert len(bins) == len(plain_best_fit([r["length"] for r in rows], capacity))


def test_packing(spark, sf_dir, tk, edge_docs, no_docs, bpe_json):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check_packed(queries.op1_best_fit_packing(spark, sf_dir).collect(), {r["doc_id"]: [r["text"]] for r in docs.collect()}, tk)
    texts = defaultdict(list)
    for r in edge_docs.collect():
        texts[r["doc_id"]].append(r["text"])
    check_packed(packing.pack(edge_docs, *bpe_json).collect(), texts, tk)
    assert packing.pack(no_docs, *bpe_json).count() == 0


def test_token_counts(spark, sf_dir, tk, edge_docs, no_docs, bpe_json):
    for df, got in ((spark.read.parquet(f"{sf_dir}/documents.parquet"), queries.op10_token_counts(spark, sf_dir)), (edge_docs, token_counts.token_counts(edge_docs, *bpe_json))):
        lengths = [len(tk.encode(r["text"] or "", add_special_tokens=False).ids) for r in df.collect()]
        rows = {r["n_tokens"]: r for r in got.collect()}
        assert {k: r["n_docs"] for k, r in rows.items()} == dict(Counter(lengths))
        for k, r in rows.items():
            assert r["docs_from"] == sum(n >= k for n in lengths) and r["tokens_from"] == sum(n for n in lengths if n >= k)
            assert r["docs_upto"] == sum(n <= k for n in lengths) and r["truncated_tokens"] == sum(min(n, k) for n in lengths)
            assert (r["total_docs"], r["total_tokens"]) == (len(lengths), sum(lengths))
        for limit in (0, 1, 100, 101, max(lengths), max(lengths) + 1):
            want = (limit, sum(min(n, limit) for n in lengths), sum(n > limit for n in lengths))
            assert tuple(token_counts.at_limit(got, limit).first()) == want
        assert token_counts.quantile(got, 0.5).first()[0] == sorted(lengths)[-(-len(lengths) // 2) - 1]
    assert token_counts.token_counts(no_docs, *bpe_json).count() == 0


# 2: fingerprints


def plain_simhash(spark, text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    if not words:
        return 0
    from pyspark.sql import functions as F

    h = [r[0] for r in spark.createDataFrame([(w, i) for i, w in enumerate(words)], "w string, i int").orderBy("i").select(F.xxhash64("w")).collect()]
    if len(h) < 5:
        terms = [spark.createDataFrame([(h,)], "h array<bigint>").select(F.xxhash64("h")).first()[0]]
    else:
        rows = [(i, *h[i : i + 5]) for i in range(len(h) - 4)]
        terms = [r[0] for r in spark.createDataFrame(rows, "i int, a bigint, b bigint, c bigint, d bigint, e bigint").select(F.xxhash64("a", "b", "c", "d", "e")).collect()]
    return sum(1 << k for k in range(64) if 2 * sum((t >> k) & 1 for t in terms) > len(terms))


def check_fingerprints(spark, rows, docs):
    fp = {}
    for i, (doc_id, text) in enumerate(docs):
        after = docs[(i + 1) % len(docs)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = rows[i]
        assert (r["doc_id"], r["n_chars"]) == (doc_id, len(text))
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        fp[i] = (text, edited, after)
        bits = lambda a, b: 1 - (int(a, 16) ^ int(b, 16)).bit_count() / 64
        assert r["near_edited"] == bits(r["fingerprint"], r["edited_fingerprint"])
        assert r["near_next"] == bits(r["fingerprint"], rows[(i + 1) % len(docs)]["fingerprint"])
    for i in list(fp)[:: max(1, len(fp) // 6)]:
        assert int(rows[i]["fingerprint"], 16) == plain_simhash(spark, fp[i][0])
        assert int(rows[i]["edited_fingerprint"], 16) == plain_simhash(spark, fp[i][1])


def test_fingerprints(spark, sf_dir, edge_docs, no_docs, monkeypatch):
    monkeypatch.setattr(simhash, "GROUP_ROWS", 7)
    docs = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    check_fingerprints(spark, queries.op2_document_fingerprints(spark, sf_dir).orderBy("doc_id").collect(), docs)
    docs = sorted(((r["doc_id"], r["text"] or "") for r in edge_docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    monkeypatch.setattr(simhash, "GROUP_ROWS", 2)
    check_fingerprints(spark, simhash.edited_pairs(edge_docs).orderBy("doc_id", "n_chars").collect(), docs)
    found = simhash.searched(edge_docs.unionAll(edge_docs.selectExpr("50", "text", "lang", "source", "n_chars", "h", "part").where("doc_id = 2"))).collect()
    assert len(found) == len(docs) + 2 and {r["near_documents"] for r in found if r["doc_id"] == 50} == {4}
    assert {r["near_documents"] for r in found if r["doc_id"] != 50} == {None}
    assert simhash.searched(no_docs).count() == 0
    prints = [(r["doc_id"], int(r["fingerprint"], 16), r["near_fingerprints"], r["near_documents"]) for r in queries.op2_document_fingerprints(spark, sf_dir).collect()]
    want = plain_neighbours([p for _, p, _, _ in prints], {p for i, p, _, _ in prints if i % 50 == 0})
    assert all((a, b) == (want[p] if i % 50 == 0 else (None, None)) for i, p, a, b in prints)
    one = edge_docs.where("doc_id = 1")
    assert simhash.edited_pairs(one).first()["near_next"] == 1.0
    assert simhash.edited_pairs(no_docs).count() == 0


def test_block_tables_find_all(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = base + [b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(6))) for b in base for _ in range(4)]
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    got = {(r["a"], r["b"]): r["distance"] for r in simhash.within_radius(spark.createDataFrame([(f,) for f in [*signed, None]], "fp bigint"), 3).collect()}
    s = sorted(set(signed))
    want = {(a, b): d for i, a in enumerate(s) for b in s[i + 1 :] if (d := ((a ^ b) & (2**64 - 1)).bit_count()) <= 3}
    assert got == want


def plain_neighbours(prints, queries, radius=3):
    """(other fingerprints, other rows) near each query by comparing it with every row."""
    out = {}
    for q in queries:
        near = [p for p in prints if (p ^ q).bit_count() <= radius]
        out[q] = (len(set(near)) - 1, len(near) - 1)
    return out


@pytest.mark.parametrize("block", [2, 64])
def test_neighbours_of_queries(spark, block, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(20)]
    family = [base[0] ^ (1 << k) for k in range(30)]  # a close family, and copies of one fingerprint
    fps = base + family + [base[1]] * 40 + [b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(6))) for b in base for _ in range(4)]
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    from pyspark.sql import functions as F

    prints = spark.createDataFrame([*enumerate(signed), (None, signed[0])], "doc_id bigint, fp bigint")
    got = simhash.with_neighbours(prints, F.pmod("doc_id", F.lit(3)) == 0).collect()
    want = plain_neighbours([*fps, fps[0]], {f for i, f in enumerate(fps) if i % 3 == 0})
    assert len(got) == len(fps) + 1
    for r in got:
        asked = r["doc_id"] is not None and r["doc_id"] % 3 == 0
        assert (r["near_fingerprints"], r["near_documents"]) == (want[r["fp"] % 2**64] if asked else (None, None))


# 4: BPE


@settings(max_examples=120, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text("ab e'", max_size=80), st.text("aA1 \n", max_size=60)))
def test_tree_encoding_equals_the_library(bpe_ranks, reference_encoding, text):
    assert bpe.encode_text(text, *bpe_ranks) == reference_encoding.encode_ordinary(text)


@pytest.mark.parametrize("leaf", [1, 2, 3, 8])
def test_tree_joins(bpe_ranks, reference_encoding, leaf):
    tree = bpe.Bpe(rank_file(bpe_ranks[0]), leaf)
    for data in (b"a" * 1000, b"antidisestablishmentarianism" * 9, "éèß".encode() * 50, bytes(range(256))):
        assert tree.encode(data) == reference_encoding._encode_single_piece(data)
        assert tree.decode(tree.encode(data)) == data


def test_decoding_tree_joins_in_order():
    for n in (0, 1, bpe.JOINED, bpe.JOINED + 1, 5 * bpe.JOINED + 3):
        pieces = [str(i).encode() * (i % 3) for i in range(n)]
        assert bpe.concatenated(pieces) == b"".join(pieces)


def test_bpe_round_trip(spark, sf_dir, reference_encoding, edge_docs, no_docs, bpe_ranks):
    for df, got in ((spark.read.parquet(f"{sf_dir}/documents.parquet"), queries.op4_bpe_round_trip(spark, sf_dir)), (edge_docs, bpe.round_trip(edge_docs, *bpe_ranks))):
        want = Counter()
        for r in df.collect():
            ids = reference_encoding.encode_ordinary(r["text"] or "")
            want[r["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()] += 1
        assert Counter(tuple(r) for r in got.collect()) == want
    assert bpe.round_trip(no_docs, *bpe_ranks).count() == 0
    back = bpe.decoded(bpe.encoded(edge_docs, *bpe_ranks), bpe_ranks[0])
    assert Counter(tuple(r) for r in back.collect()) == Counter((r["doc_id"], r["text"] or "") for r in edge_docs.collect())


# 5: Jaccard

_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_LOW))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def plain_components(docs):
    sets = {d: plain_set(t) for d, t in docs}
    found, by = {d: d for d in sets}, defaultdict(list)

    def find(x):
        while found[x] != x:
            x = found[x]
        return x

    for d in sorted(sets):
        both = Counter(e for g in sets[d] for e in by[g])
        for e, n in both.items():
            if 100 * n >= 80 * (len(sets[d]) + len(sets[e]) - n):
                a, b = find(d), find(e)
                found[max(a, b)] = min(a, b)
        for g in sets[d]:
            by[g].append(d)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def family(rng, size, members, edits, vocabulary=400):
    base = [f"w{rng.randrange(vocabulary)}" for _ in range(size)]
    for _ in range(members):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        yield " ".join(w)


@pytest.mark.parametrize("seed,block", [(0, 2048), (1, 5), (2, 2)])
def test_components_against_brute_force(spark, seed, block, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "PAIRS", 50)
    rng = random.Random(seed)
    texts = [t for size, n, e in ((60, 30, 3), (200, 12, 8), (12, 6, 1), (6, 4, 1)) for t in family(rng, size, n, e)]
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [f"{' '.join(family(rng, 80, 1, 0))} {passage}" for _ in range(40)] + [texts[0]] * 20 + texts[3:9] + ["", "  ", "One two", "one TWO", "one two three"]
    order = list(range(len(texts)))
    rng.shuffle(order)
    docs = [(i * 3, texts[j]) for i, j in enumerate(order)]
    got = {r[0]: (r[1], r[2]) for r in jaccard.jaccard_components(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got == plain_components(docs)


def test_a_large_family_is_linear_and_exact(spark):
    rng = random.Random(5)
    docs = list(enumerate(dict.fromkeys(family(rng, 100, 3000, 4, 10**6))))
    docs += [(10_000 + i, t) for i, t in enumerate(family(rng, 100, 40, 12, 10**6))]
    base = docs[0][1].split()
    for i in range(30):  # at the edge of the threshold
        w = list(base)
        for j in range(9):
            w[5 + 10 * j] = f"y{i}{j}" if j < 2 + i % 4 else w[5 + 10 * j]
        docs.append((20_000 + i, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    sets = jaccard._Sets(df, 5, 80)
    cells = jaccard._cells(jaccard._labelled(sets.shared.select("h", "doc_id", "n"), jaccard.components(jaccard.close_pairs(jaccard.stored(sets.with_leaders()), sets.heads, 80))))
    assert sets.with_leaders().count() <= len(docs) and cells.count() <= 2 * sets.shared.count()
    got = {r[0]: (r[1], r[2]) for r in jaccard.jaccard_components(df).collect()}
    assert got == plain_components(docs)


@pytest.mark.parametrize("few,hot", [(8, 1 << 12), (0, 2)])
def test_links_against_brute_force(spark, few, hot, monkeypatch):
    monkeypatch.setattr(jaccard, "FEW", few)
    monkeypatch.setattr(jaccard, "HOT_ROWS", hot)
    monkeypatch.setattr(jaccard, "HOT", 1 << 12)
    rng = random.Random(9)
    texts = [t for size, n, e in ((60, 25, 4), (12, 6, 1)) for t in family(rng, size, n, e)]
    texts += texts[:3] + ["", "one two"]
    docs = list(enumerate(texts)) + [(0, texts[0])]
    sets, rep = {d: frozenset(plain_set(t)) for d, t in docs}, {}
    for d in sorted(sets):
        rep.setdefault(sets[d], d)
    reps = [(d, s) for s, d in rep.items() if s]
    want = {(a, b) for a, x in reps for b, y in reps if a < b and 100 * len(x & y) >= 80 * len(x | y)}
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert {(r["a"], r["b"]) for r in jaccard.jaccard_links(df).collect()} == want
    assert {r[0]: (r[1], r[2]) for r in jaccard.jaccard_components(df).collect()} == plain_components(docs)


def test_cross_pairs_of_a_large_cell_hold_little():
    import tracemalloc

    rng = np.random.default_rng(5)
    base = np.unique(rng.integers(1, 2**63, 3500, dtype=np.uint64))
    sets = []
    for i in range(1200):  # widths 128 to 1024 bytes, two of them within reach of each other's sizes
        n = int(rng.choice([250, 300, 600, 2040, 2100]))
        s = base[:n].copy()
        s[rng.choice(n, n // int(rng.choice([4, 40])), replace=False)] = rng.integers(1, 2**63, 1, dtype=np.uint64)
        sets.append(np.unique(s))
    label = np.sort(rng.integers(0, 3, len(sets)))
    sketches, first = [jaccard.parity(s).tobytes() for s in sets], [np.arange(i * 4, i * 4 + 4, dtype=np.uint64).tobytes() for i in range(1, len(sets) + 1)]
    n, one = np.array([len(s) for s in sets], np.int32), np.zeros(len(sets), np.int64)
    table = pa.table({"h": one, "i": one, "j": one, "block": one, "doc_id": np.arange(len(sets)), "n": n, "label": label, "sketch": sketches, "first": first})
    got, most = set(), 0
    tracemalloc.start()
    for a, b, *_ in jaccard._cross_pairs(table, 80, False):
        most = max(most, tracemalloc.get_traced_memory()[1])
        got |= set(zip(a.tolist(), b.tolist()))
    tracemalloc.stop()
    x, y = np.triu_indices(len(sets), 1)
    keep = (label[x] != label[y]) & (100 * np.minimum(n[x], n[y]).astype(np.int64) >= 80 * np.maximum(n[x], n[y]))
    x, y = x[keep], y[keep]
    ok = jaccard._may_link(n[x], n[y], [sketches[i] for i in x], [sketches[i] for i in y], 80)
    assert got == set(zip(x[ok].tolist(), y[ok].tolist())) and 0 < ok.sum() < len(ok)
    assert len({len(s) for s in sketches}) >= 3 and most < 80e6


def test_jaccard_query_and_edges(spark, sf_dir, edge_docs, no_docs):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert {r[0]: (r[1], r[2]) for r in queries.op5_ngram_jaccard_join(spark, sf_dir).collect()} == plain_components(docs)
    rows = Counter(tuple(r) for r in jaccard.jaccard_components(edge_docs).collect())
    assert rows == Counter([(1, 2, 1), (2, 2, 1), (2, 2, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5), (None, 1, None), (6, 1, 6), (7, 1, 7), (8, 1, 8)])
    assert jaccard.jaccard_components(no_docs).count() == 0


def test_repeated_doc_id_with_other_texts(spark):
    a, b = "a b c d e f g h i j", "k l m n o p q r s t"
    df = spark.createDataFrame([(5, a), (5, b), (1, a), (9, b)], "doc_id bigint, text string")
    assert {(r[0], r[2]) for r in jaccard.jaccard_components(df).collect()} == {(5, 1), (1, 1), (9, 1)}


def test_shingles_of_blocks(monkeypatch):
    from vocalith.llm import shingles

    texts = ["Ab cd\tef gh ij kl", "x" * 600 + " y z", None, "", "one", "é ß a b c d\x0be"] + ["w%d" % i * 3 + " q" for i in range(50)]
    whole = [s.tolist() for s in shingle_sets(pa.array(texts))]
    monkeypatch.setattr(shingles, "BLOCK_BYTES", 16)
    assert [s.tolist() for s in shingle_sets(pa.array(texts))] == whole
    assert [len(s) for s in whole] == [len(plain_set(t)) for t in texts]


# 6: toxicity


def make_labelled(rng, n):
    clean = ["the", "house", "tree", "walks", "slowly", "Berlin", "water,", "green", "you", "and"]
    bad = ["idiot", "moronic", "m0ron", "scummy", "loser"]
    for i in range(n):
        words = [rng.choice(clean) + (str(rng.randrange(50)) if rng.random() < 0.3 else "") for _ in range(rng.randrange(20, 60))]
        toxic = int(rng.random() < 0.25)
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        yield i, " ".join(words), toxic


def test_toxicity_held_out(spark, edge_docs, no_docs):
    rows = list(make_labelled(random.Random(2), 900))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(10_000, 1, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    held = [(got[i], y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(r["held_out"] for r, _ in held) and sum(r["held_out"] for r in got.values()) == len(held)
    assert np.mean([(r["predicted"] == y) for r, y in held]) > 0.97
    assert all((r["score"] >= 0.7) == r["predicted"] and 0 <= r["score"] <= 1 for r in got.values())
    assert toxicity.score(edge_docs, model).count() == edge_docs.count()
    assert toxicity.score(no_docs, model).count() == 0
    kept = toxicity.reject(docs, model)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if not r["predicted"]}
    assert toxicity.fit(docs, labels.where("false")).score(["x"])[0] == 0.0
    assert toxicity.fit(docs, labels.where("toxic = 1")).score(["x"])[0] == 1.0


def test_held_out_labels_are_never_read(spark):
    rows = list(make_labelled(random.Random(3), 300))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    flip = lambda i, y: 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y
    a, b = (spark.createDataFrame([(i, f(i, y)) for i, _, y in rows], "doc_id bigint, toxic int") for f in (lambda i, y: y, flip))
    scores = [toxicity.fit(docs, x).score([t for _, t, _ in rows]).tolist() for x in (a, b)]
    assert scores[0] == scores[1]


def test_isotonic():
    x, y = toxicity.isotonic(np.array([3.0, 1.0, 2.0, 4.0]), np.array([0.0, 0.0, 1.0, 1.0]))
    assert y.tolist() == sorted(y.tolist()) and len(x) == len(y)


# 7: PII

_PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for kind, p in _PLAIN.items():
        for m in re.finditer(p, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text("a1@.- +()\u0663", max_size=40), st.text("0123456789.- +", max_size=60), st.lists(st.sampled_from(["a@b.co", "4041894974608795", "1.2.3.4", "300.1.2.3", "+1 (988) 555-2485", ".", "@", " ", "x", "é"]), max_size=12).map("".join)))
def test_base_spans_equal_plain_patterns(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_base_spans_are_linear():
    for text in ("a" * 300_000, "1" * 300_000, "a@" * 100_000, "1." * 100_000, "+1 " * 100_000):
        pii.base_spans(text)


def test_pii_query(spark, sf_dir, edge_docs, no_docs):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.op7_pii_spans(spark, sf_dir).collect():
        base = plain_spans(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in base) for k in pii.KINDS]
        assert r["base_sha256"] == hashlib.sha256(pii.written(base).encode()).hexdigest()
        assert r["spans"].startswith(pii.written(base))
    assert pii.spans_of(edge_docs).count() == edge_docs.count()
    assert pii.spans_of(no_docs).count() == 0


def test_disclosing_terms(spark):
    rows = [(i, f"plain words here and more words Zorblax a{i}@b.com then plain words follow on for a while here and there") for i in range(60)]
    rows += [(400 + i, "copied words Quuxly same@copy.org and some more") for i in range(80)]
    rows += [(100 + i, "plain words here and more words then follow on for a while there") for i in range(200)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, spans string")
    terms = {r["term"]: r for r in pii.disclosing_terms(df).collect()}
    assert set(terms) == {"zorblax"} and terms["zorblax"]["share"] == 1.0
    near, words = 60 * 6 + 80 * 6, 60 * 21 + 80 * 9 + 200 * 13  # an address holds three of the words
    assert [terms["zorblax"][c] for c in ("bits", "content")] == pytest.approx([np.log2(words / near)] * 2)
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    assert "Zorblax" not in clean[0] and "<EMAIL>" in clean[0] and clean[100] == rows[140][1] and "Quuxly" in clean[400]


def test_a_name_beside_its_own_address_is_disclosing(spark):
    rng = random.Random(7)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(3)) for _ in range(n))
    rows = [f"{prose(60)} Quuxly same@copy.org {prose(60)}" for _ in range(4)]
    copied = prose(80).split()
    for i in range(40):  # one text, edited at one word: not support
        rows.append(" ".join([*copied[:30], "Plugh", "one@text.org", *copied[30:i + 31], prose(1), *copied[i + 32 :]]))
    rows += [f"{prose(60)} Xyzzy common@where.org {prose(60)}" for _ in range(4)] + [f"{prose(60)} Xyzzy {prose(60)}" for _ in range(5)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id bigint, text string")
    texts = Counter(r["term"] for r in pii.near_counts(df).where("term in ('quuxly', 'plugh', 'xyzzy')").collect())
    assert texts == {"quuxly": 4, "plugh": 1, "xyzzy": 4}
    terms = {r["term"]: r for r in pii.disclosing_terms(df).collect()}
    assert set(terms) == {"quuxly"} and terms["quuxly"]["one"] == 4 and terms["quuxly"]["left"] == 0
    clean = [r["text"] for r in pii.sanitise(df).orderBy("doc_id").collect()]
    assert not any("Quuxly" in t for t in clean[:4]) and all("Plugh" in t for t in clean[4:44]) and all("Xyzzy" in t for t in clean[44:])
    extra = [r["spans"] for r in pii.spans_of(df).orderBy("doc_id").collect()]
    assert all(f"removed:{t.index('Quuxly')}:{t.index('Quuxly') + 6}" in s for t, s in zip(rows[:4], extra)) and not any("removed" in s or "term" in s for s in extra[4:])


def test_words_near_an_entity_have_no_length_limit():
    text = f"Zorblax {'x' * 500} {'y' * 300} a@b.co, 1.2.3.4 q@r.st {'z' * 200} end more"
    got = [text[s:e] for s, e in pii._near(text, pii.base_spans(text))]
    assert got == ["Zorblax", "x" * 500, "y" * 300, "z" * 200, "end", "more"]


def plain_disclosure(texts):
    """Counts and decisions by the definitions; the texts are all different, so each is a family of its own."""
    import math

    near, families, entity, anywhere, words = Counter(), defaultdict(set), defaultdict(set), Counter(), 0
    at_entity = Counter()
    for i, t in enumerate(texts):
        found = [(m.start(), m.end()) for m in pii._WORD.finditer(t)]
        words += len(found)
        anywhere.update(t[s:e].lower() for s, e in found)
        base = plain_spans(t)
        outside = [w for w in found]
        picked = set()
        for _, s, e in base:
            picked |= {*[w for w in outside if w[1] <= s][-3:], *[w for w in outside if w[0] >= e][:3]}
        for s, e in picked:
            if not any(a < e and s < b for _, a, b in base):
                kind, a, b = min(sorted(base, key=lambda z: z[1]), key=lambda z: max(z[1] - e, s - z[2]))
                w = t[s:e].lower()
                near[w, kind] += 1
                families[w, kind].add((i, t[a:b]))
                at_entity[w, t[a:b]] += 1
                entity[w, t[a:b]].add(i)
    rate = Counter()
    for (_, k), n in near.items():
        rate[k] += n / words
    out = set()
    for (w, k), n in near.items():
        chance = anywhere[w] * rate[k]
        if len(families[w, k]) >= 20 and n - chance >= 5 * math.sqrt(chance) and math.log2(n / anywhere[w] / rate[k]) >= -math.log2(rate[k]) / 2:
            out.add(w)
    return out | {w for (w, e), n in at_entity.items() if len(entity[w, e]) >= 2 and n * 2 >= anywhere[w]}


def planted_disclosure(seed):
    """Prose with addresses and numbers; 'mailto' and 'dial' stand beside them, 'kind' anywhere, one name by its address."""
    rng = random.Random(seed)
    word = lambda: rng.choice(["kind"] * 2 + ["".join(rng.choice("abcdefgh") for _ in range(3))] * 30)
    prose = lambda n: " ".join(word() for _ in range(n))
    rows = [prose(150) for _ in range(60)]
    for i in range(40):
        rows.append(f"{prose(70)} mailto {prose(1)} u{i}@mail{i}.org {prose(70)}" + (" mailto" if i < 5 else ""))
        rows.append(f"{prose(70)} dial +1 555 {i:03d} 7788 {prose(70)}")
    return rows + [f"{prose(60)} Marcellus own@self.org {prose(60)}" for _ in range(3)]


@pytest.mark.parametrize("seed,most", [(1, 1 << 16), (2, 2)])
def test_disclosure_against_brute_force(spark, seed, most, monkeypatch):
    monkeypatch.setattr(pii, "MOST_TERMS", most)  # 2: a lot, and a pass, per term
    rows = planted_disclosure(seed)
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    got = {r["term"]: r for r in pii.disclosing_terms(df).collect()}
    assert set(got) == plain_disclosure(rows) and {"mailto", "dial", "marcellus"} <= set(got) and "kind" not in got
    assert got["mailto"]["kind"] == "email" and got["dial"]["kind"] == "phone"
    for r in pii.spans_of(df).collect():
        t = rows[r["doc_id"]]
        base, extra = pii.find_spans(t, {w: x["share"] >= 0.9 for w, x in got.items()}, frozenset(w for w, x in got.items() if x["share"] >= 0.9))
        assert r["spans"] == pii.written(base + extra)


def test_edge_rows_survive_sanitising(spark, edge_docs):
    out = pii.sanitise(edge_docs)
    assert out.columns == edge_docs.columns
    assert Counter(map(tuple, out.collect())) == Counter(map(tuple, edge_docs.collect()))


def test_url_oracle(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{sf_dir}/pages.parquet'")
    got = sorted((tuple(r) for r in queries.op3_url_filters(spark, sf_dir).collect()), key=repr)
    assert got == sorted(con.execute(queries.ORACLE_SQL["op3_url_filters"]).fetchall(), key=repr)
