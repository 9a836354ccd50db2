"""Results against brute force, and the laws of each method."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import oracle
from acctrisk.llm import bpe, catalog, components, jaccard, lines, mixing, neighbours, packing, quality, shards, tokens


SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_agrees_with_sql(spark, name):
    assert oracle.compare(spark, oracle.database(SF_DIR), name, SF_DIR) == ""


@pytest.fixture(scope="module")
def texts(spark):
    return {r[0]: r[1] or "" for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()}


def test_ids_are_the_tokenizers():
    from tokenizers import Tokenizer

    own, theirs = bpe.Encoder(bpe.default_path()), Tokenizer.from_file(bpe.default_path())
    theirs.encode_special_tokens = True
    rng = np.random.default_rng(1)
    parts = ["a", "B", "é", "1", "²", "'", "'s", "'re", "'LL", " ", "  ", "\n", "\t", "\x1c", "\x85", "　", ".", "%%", "<|endoftext|>", "日本", "🙂", "\r\n"]
    for _ in range(2000):
        text = "".join(rng.choice(parts, rng.integers(0, 12)))
        assert own(text).tolist() == theirs.encode(text, add_special_tokens=False).ids


def test_packing_is_whole_and_tight(spark, texts):
    rows = catalog.op8_packing(spark, SF_DIR).collect()
    encode = bpe.Encoder(bpe.default_path())
    lengths = collections.Counter()
    for r in rows:
        lengths[r["doc_id"]] += r["length"]
    assert lengths == {i: len(encode(t)) + 1 for i, t in texts.items()}
    by = collections.defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in by.values():
        own.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and own[0][0] == 0 and sum(own[-1]) <= 2048
    assert len(by) <= -(-sum(lengths.values()) // 2048) + 10


def test_plan_uses_every_piece_once():
    rng = np.random.default_rng(2)
    for capacity in (1, 7, 64, 300):
        counts = {int(n): int(c) for n, c in zip(rng.permutation(capacity)[:40] + 1, rng.integers(1, 50, 40))}
        used = collections.Counter()
        for contents, n in packing.plan(counts, capacity):
            assert n > 0 and sum(contents) <= capacity
            for x in contents:
                used[x] += n
        assert used == counts


def test_token_counts(spark, texts):
    encode = bpe.Encoder(bpe.default_path())
    got = {r["doc_id"]: r["n_tokens"] for r in catalog.op4_token_counts(spark, SF_DIR).collect()}
    assert got == {i: len(encode(t)) for i, t in texts.items()}


def test_spans_are_stitched_across_blocks(spark):
    rng = np.random.default_rng(3)
    ids = rng.choice([5, 6, 9], 500, p=[.45, .45, .1])
    cuts = [0, 3, 3 + 7, 200, 201, 490, 500]
    blocks = [("f", i, b - a, [int(p) for p in np.flatnonzero(ids[a:b] == 9) + a]) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    table = spark.createDataFrame(blocks, "file string, block int, tokens long, ends array<long>")
    got = sorted((r["ordinal"], r["start"], r["n_tokens"], r["ended"]) for r in tokens.document_spans(table).collect())
    want, start = [], 0
    for p in np.flatnonzero(ids == 9).tolist():
        want.append((len(want), start, p - start, True))
        start = p + 1
    if start < 500:
        want.append((len(want), start, 500 - start, False))
    assert got == want


def shingle_set(text):
    own = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).translate({c: " " for c in range(9, 14)}).split(" ")
    own = [w for w in own if w]
    return {tuple(own[i:i + 5]) for i in range(len(own) - 4)} if len(own) >= 5 else {tuple(own)} if own else set()


def brute_components(sets):
    links, ids = {i: i for i in sets}, sorted(sets)

    def root(x):
        while links[x] != x:
            x = links[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                links[y] = x
    return {i: root(i) for i in ids}


def test_jaccard_join(spark, texts):
    sets = {i: shingle_set(t) for i, t in texts.items()}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in catalog.op5_jaccard_join(spark, SF_DIR).collect()}
    assert got == {i: (len(sets[i]), c) for i, c in brute_components(sets).items()}


def test_jaccard_join_near_the_threshold(spark, monkeypatch):
    """Chains of edits around the threshold, in groups of many trees."""
    monkeypatch.setattr(jaccard, "TREE", 20)
    rng = np.random.default_rng(4)
    texts, base = {}, None
    for i in range(160):
        if i % 40 == 0:
            base = [f"w{rng.integers(50_000)}" for _ in range(120)]
        own = list(base if i % 3 else base[:rng.integers(90, 121)])
        for _ in range(rng.integers(0, 4)):
            own[rng.integers(len(own))] = f"x{rng.integers(50_000)}"
        texts[i] = " ".join(own)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    want = brute_components({i: shingle_set(t) for i, t in texts.items()})
    got = {r["doc_id"]: r["component_id"] for r in jaccard.similar_texts(docs).collect()}
    assert got == want and len(set(want.values())) < 160


def test_components(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (150, 2))] + [(1000 + i, 1001 + i) for i in range(50)]
    label = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in label:
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    got = components.components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()
    assert {r[0]: r[1] for r in got} == label and len(got) == len(label)


def test_near_vectors_with_full_lists(spark, monkeypatch):
    """Pairs of groups of 20 near copies, linked with each other: own copies fill every list. Nothing is left to the audit."""
    whole = neighbours.audit
    monkeypatch.setattr(neighbours, "audit", lambda vectors, threshold: whole(vectors, threshold, sample=0))
    rng = np.random.default_rng(3)
    rows = [rng.standard_normal((2000, 64))]
    for _ in range(10):
        a, b = np.linalg.qr(rng.standard_normal((64, 2)))[0].T
        for centre in (a, 0.93 * a + (1 - 0.93 ** 2) ** 0.5 * b):
            rows.append(centre + 0.006 * rng.standard_normal((20, 64)))
    x = rng.permutation(np.concatenate(rows))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= neighbours.THRESHOLD
    np.fill_diagonal(near, False)
    nodes, least = components.roots(*np.nonzero(near))
    component = dict(enumerate(range(len(x)))) | dict(zip(nodes.tolist(), least.tolist()))
    assert collections.Counter(collections.Counter(component.values()).values())[40] == 10
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in neighbours.near_duplicates(table).collect()}
    assert got == {i: (int(near[i].sum()), component[i]) for i in range(len(x))}


def test_mix_follows_the_weights(spark):
    rows = [(i, s) for i, s in enumerate(["a"] * 300 + ["b"] * 220 + ["c"] * 100)]
    weights, block = {"a": 5, "b": 3, "c": 2}, 4
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    got = sorted((r["mix_position"], r["mix_phase"], r["source"]) for r in mixing.mix(docs, weights, block_rows=block).collect())
    assert [r[0] for r in got] == list(range(len(rows)))
    seen = collections.Counter()
    for p, (_, phase, s) in enumerate(got):
        seen[s] += 1
        if phase == 0 and (p + 1) % block == 0:
            for x, w in weights.items():
                assert abs(seen[x] / block - (p + 1) / block * w / 10) < 1


def test_frame_meets_all_deadlines(spark):
    rng = np.random.default_rng(6)
    for _ in range(5):
        w = [int(x) for x in rng.integers(1, 9, 6)]
        order = spark.range(1).select(mixing.edf_frame(F.array(*[F.lit(x).cast("long") for x in w]))).first()[0]
        taken = collections.Counter()
        for slot, s in enumerate(order):
            i = taken[s]
            taken[s] += 1
            assert i * sum(w) // w[s] <= slot < -(-(i + 1) * sum(w) // w[s])
        assert taken == dict(enumerate(w))


def test_shards_are_even_and_keep_groups(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot " * 20).otherwise(
        F.concat(F.lit("text "), (F.col("id") % 1500).cast("string"), F.repeat(F.lit("x"), (F.col("id") % 97).cast("int")))).alias("text"))
    rows = shards.assign_shards(docs, 8).collect()
    size = collections.Counter()
    for r in rows:
        size[r["shard"]] += r["size"]
    mean = sum(size.values()) / 8
    assert len(rows) == 4000 and len(size) == 8 and max(abs(v - mean) for v in size.values()) < 0.03 * mean
    for s in size:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))


def test_shards_are_written_with_all_rows(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a", "q"), (1, "a", "r"), (None, None, "s"), (2, "b", "t")], "doc_id long, text string, own string")
    shards.write_shards(docs, str(tmp_path / "out"), 2)
    assert sorted(r["own"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["q", "r", "s", "t"]


def test_lines_by_hand(spark):
    shared = "This line is shared by very many documents, indeed."
    docs = [(i, f"own {i}\n  {shared.upper() if i % 2 else shared}\t\nend {i}") for i in range(6)]
    out = {r["doc_id"]: r["kept_text"] for r in lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert out == {i: t if i == 5 else f"own {i}\nend {i}" for i, t in docs}


def test_quality_holds_out(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = quality.weighed(docs, labels, fit_rows=2000).collect()
    good, bad = quality.fitted_labels(labels, "doc_id", "quality", 2000)
    fitted, truth = {*good.tolist(), *bad.tolist()}, {r["doc_id"]: r["quality"] for r in labels.collect()}
    held = [(truth[r["id"]], r["accepted"]) for r in rows if r["id"] in truth and r["id"] not in fitted]
    assert len(held) > 150 and np.mean([bool(q) == a for q, a in held]) > 0.93
    assert np.mean([a for q, a in held if q]) > 0.97


def test_top_k_is_exact(spark):
    rng = np.random.default_rng(7)
    keys = np.concatenate([rng.normal(0, 100, 500), np.full(300, 2.5), [1e12]])
    table = spark.createDataFrame([(i, float(k)) for i, k in enumerate(keys)], "id long, key double")
    for k in (0, 1, 10, 300, 450, 801, 900):
        got = {r["id"] for r in quality.top_k(table, "key", k).where("selected").collect()}
        assert got == set(sorted(range(len(keys)), key=lambda i: (-keys[i], i))[:k])


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF_DIR)
        assert out.columns == docs.columns, name
        rows = out.select("doc_id").collect()
        assert {r[0] for r in rows} <= {r[0] for r in docs.select("doc_id").collect()} and len(rows) == len({r[0] for r in rows})
        docs = out
    left = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(set(left.values())) == len(left)
    assert len(set(brute_components({i: shingle_set(t) for i, t in left.items()}).values())) == len(left)
    assert {r["doc_id"] for r in entry.queries()["pipeline"](spark, SF_DIR).collect()} == set(left)


def test_pipeline_packs_in_the_order_of_the_mix(spark):
    """Sources lie apart by id; along the sequences they come by their weights until one runs dry."""
    import corpus_pipeline
    from acctrisk.llm.common import stored

    source = {i: f"src{0 if i < 600 else 1 if i < 900 else 2}" for i in range(1300)}
    docs = spark.createDataFrame([(i, "some words " * (60 + i % 3), s) for i, s in source.items()], "doc_id long, text string, source string")
    mixed = stored(corpus_pipeline.mix_sources(spark, stored(docs), SF_DIR))
    rows = corpus_pipeline.pack(spark, mixed, SF_DIR).collect()
    assert {r["doc_id"] for r in rows} == set(source) and len(rows) == len(source)
    last = max(r["sequence_id"] for r in rows)
    assert {r["sequence_id"] for r in rows} == set(range(last + 1))
    spaces = collections.defaultdict(list)
    for r in rows:
        spaces[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in spaces.values():
        held.sort()
        assert [o for o, _ in held] == [sum(n for _, n in held[:i]) for i in range(len(held))] and sum(n for _, n in held) <= 2048
    head = collections.Counter(source[r["doc_id"]] for r in rows if r["sequence_id"] <= last // 2)
    tail = collections.Counter(source[r["doc_id"]] for r in rows if r["sequence_id"] > last * 0.9)
    for name, weight in catalog.MIX_WEIGHTS.items():
        assert abs(head[name] / sum(head.values()) - weight / 11) < 0.05
    assert tail["src2"] > 0.9 * sum(tail.values())
