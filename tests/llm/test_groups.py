"""Operators over pairs, models and relations: SimHash, NN-descent, pieces, language model, chats, pipeline."""

from __future__ import annotations

import json
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from topicloom.llm import chat, nn_descent, pieces, pitman_yor, simhash
from topicloom.llm.graph import connected_components


class Sets:
    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(1000, 1060)] + [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(50)] + [(5, 5), (1, 2), (2, 1)]
    edges += [(2 ** 62, i) for i in range(300, 340)]
    sets = Sets()
    for a, b in edges:
        if a != b:
            sets.join(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: sets.find(x) for x in sets.up}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- SimHash

def plain_fingerprint(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    import xxhash
    shingles = [" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_texts(seed, n=60):
    rng = random.Random(seed)
    base = ["w%d" % rng.randint(0, 10 ** 6) for _ in range(400)]
    texts = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = "x%d" % rng.randint(0, 10 ** 6)
        texts.append(" ".join(words))
    return texts


def test_simhash_against_all_pairs(make_docs):
    texts = near_texts(1) + near_texts(2) + ["", None, "Ä b", "ä b", "A B", "a\x0bb", "only"] + near_texts(1)[:5]
    rows = [(10 + i, t) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in simhash.classes(make_docs(rows, {"fp": 1, "root": 2})).collect()}
    prints = {i: plain_fingerprint(t, 3) for i, t in rows}
    sets = Sets()
    for a in prints:
        sets.find(a)
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3:
                sets.join(a, b)
    assert {i: (f"{p:016x}", sets.find(i)) for i, p in prints.items()} == {i: (r.fingerprint, r.component_id) for i, r in got.items()}
    kept = simhash.drop_near_duplicates(make_docs(rows, {"fp": 1}))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({sets.find(i) for i in prints}) and "fp" in kept.columns


def test_every_close_pair_meets():
    rng = random.Random(4)
    for bits in (1, 3, 4):
        masks = [m & (1 << 64) - 1 for m in simhash.block_masks(bits)]
        for _ in range(200):
            difference = sum(1 << b for b in rng.sample(range(64), bits))
            assert any(difference & m == 0 for m in masks)


def test_simhash_rows_without_ids_and_repeats(make_docs):
    rows = [(None, "alpha beta gamma delta"), (None, "alpha beta gamma delta"), (None, "quite other words here"), (4, "lone text of four"), (4, "lone text of four")]
    kept = simhash.drop_near_duplicates(make_docs(rows)).collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter({(None, rows[0][1]): 1, (None, rows[2][1]): 1, (4, rows[3][1]): 1})
    assert {r.component_id for r in simhash.classes(make_docs(rows)).collect()} == {None, 4}
    assert simhash.drop_near_duplicates(make_docs(rows).limit(0)).count() == 0


# ---- embeddings

def test_nn_descent_against_all_pairs(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 16))
    close = np.repeat(x[:40], 5, axis=0) + rng.normal(size=(200, 16)) * 0.08
    dense = x[50] + rng.normal(size=(150, 16)) * 0.02
    all_x = np.concatenate([x, close, dense, x[:10], x[:5] * 3])
    labels = [int(v) for v in rng.integers(0, 2, len(all_x))]
    rows = [(int(i), [float(v) for v in e], l) for i, (e, l) in enumerate(zip(all_x, labels))]
    odd = [(9000, None, 1), (9001, [0.0] * 16, 1), (9002, [float("nan")] * 16, 1), (9003, rows[0][1], None), (9004, [1.0, None], 1), (9005, [], 0), (9006, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int").withColumn("node", F.lit(1)).withColumn("v", F.lit(2))
    got = {r.vec_id: r for r in nn_descent.near_duplicates(df).collect()}
    unit = all_x / np.linalg.norm(all_x, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.98) & (np.array(labels)[:, None] == np.array(labels))
    np.fill_diagonal(near, False)
    sets = Sets()
    for i in range(len(all_x)):
        sets.find(i)
        for j in np.flatnonzero(near[i]):
            sets.join(i, int(j))
    assert len(got) == len(rows) + len(odd)
    for i in range(len(all_x)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (near[i].sum(), sets.find(i), sets.find(i) == i)
    assert all((got[o[0]].n_links, got[o[0]].component_id, got[o[0]].kept) == (0, o[0], True) for o in odd)
    assert nn_descent.near_duplicates(df.limit(0)).count() == 0


def test_dense_lobes_meet(spark):
    rng = np.random.default_rng(5)
    a, b = np.eye(24)[0], 0.985 * np.eye(24)[0] + math.sqrt(1 - 0.985 ** 2) * np.eye(24)[1]
    x = np.concatenate([np.repeat([a], 200, axis=0), np.repeat([b], 200, axis=0)]) + rng.normal(size=(400, 24)) * 0.003
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.98
    df = spark.createDataFrame([(i, [float(v) for v in e], 0) for i, e in enumerate(x)], "vec_id long, embedding array<double>, label int")
    rules = nn_descent.DescentRules(longest=16, block=64, audit_nodes=0)
    got = {r.vec_id: r for r in nn_descent.near_duplicates(df, rules).collect()}
    assert near[:200, 200:].sum() > 30_000
    assert all((got[i].n_links, got[i].component_id) == (near[i].sum() - 1, 0) for i in range(400))


def test_search_that_does_not_pass_raises(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(v) for v in rng.normal(size=8) * 0.01 + 1], 0) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    with pytest.raises(RuntimeError, match="audit"):
        nn_descent.near_duplicates(df, nn_descent.DescentRules(max_rounds=1))
    # the audit adds nothing: with one node audited the links come from the search
    got = nn_descent.near_duplicates(df, nn_descent.DescentRules(audit_nodes=1)).collect()
    assert all(r.n_links == 59 and r.audit_recall == 1.0 for r in got)


def test_class_blocks_count_every_link(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(v) for v in rng.normal(size=8) * 0.01 + 1], 0) for i in range(90)]
    df = spark.createDataFrame(rows + [(500, None, 0)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in nn_descent.near_duplicates(df, nn_descent.DescentRules(block=16)).collect()}
    assert all(got[i] == 89 for i in range(90)) and got[500] == 0


# ---- pieces

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
ODD = ["", " ", "a  b", " lead x\ny\t z", "日本語テスト 門 ☃ a\x00b", None, "trail   ", "x" * 3000 + " " + "abc" * 500, "      lots     of    spaces          ",
       "Erblest it hein, tionnted!", "éàü ß çrêpe", "ab", "a"]


def test_pieces_equal_the_library(make_docs):
    sentencepiece = pytest.importorskip("sentencepiece")
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    table = pieces.load_pieces(MODEL)
    docs = make_docs([*enumerate(ODD), (0, ""), (None, "no id")], {"unit": 1, "ids": 2})
    encoded = pieces.encode_documents(docs, table)
    rows = pieces.decode(encoded, table).collect()
    texts = dict(enumerate(ODD)) | {None: "no id"}
    assert len(rows) == len(ODD) + 2
    assert all(list(r.ids) == library.encode(texts[r.doc_id] or "") and r.text == (texts[r.doc_id] or "") for r in rows)
    assert pieces.encode_documents(docs.limit(0), table).count() == 0


def test_blocks_of_pieces_are_bounded(spark):
    """what a task knows of an input partition ends after ``held_words`` words, and documents come out whole."""
    table = pieces.load_pieces(MODEL)
    texts = [f"word{i} and{i % 7} another{i * 31} Ωmega{i % 3}" for i in range(200)]
    batches = [pa.RecordBatch.from_pydict({"doc_id": [i], "text": [t], "block": [5]}) for i, t in enumerate(texts)]
    seen, bridges = set(), table.bridges()
    for numbering, block, rows in pieces._numbered(iter(batches), bridges, 50):
        numbering.add(rows.column(1))
        seen.add(block)
        assert len(numbering.words) < 50 + 5
    assert len(seen) > 5 and {b // pieces.BLOCKS for b in seen} == {5}
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(2)
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        few = {r.doc_id: (r.n_units, list(r.ids)) for r in pieces.encode_documents(docs, table, held_words=50, part_bytes=1000).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    whole = {r.doc_id: (r.n_units, list(r.ids)) for r in pieces.encode_documents(docs, table).collect()}
    assert few == whole and len(few) == 200


def all_paths(unit, known, longest):
    if not unit:
        yield 0.0, ()
        return
    for n in range(1, min(longest, len(unit)) + 1):
        head = unit[:n]
        if head in known or n == 1:
            for score, rest in all_paths(unit[n:], known, longest):
                yield score + known.get(head, min(known.values()) - 10), (head, *rest)


def test_viterbi_against_all_paths(spark):
    rng = random.Random(8)
    known = {"".join(rng.choice("abc") for _ in range(n)): -rng.random() * 9 for n in (1, 1, 2, 2, 2, 3, 3, 4) for _ in range(3)}
    table = pieces.PieceTable(tuple(known), tuple(known.values()), tuple(range(300, 300 + len(known))), 3, merges=False)
    units = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(1, 9))) for _ in range(60)})
    encoded = pieces.encode_units(spark.createDataFrame([(u,) for u in units], "unit string"), table)
    number = dict(zip(known, table.ids))
    merger = pieces.Merger(table)
    for r in encoded.collect():
        _, best = max(all_paths(r.unit, known, table.longest))
        want = [i for p in best for i in ([number[p]] if p in number else [3 + b for b in p.encode()])]
        assert list(r.ids) == want == merger.encode(r.unit)


def test_parts_of_a_batch_equal_parts_of_each_text():
    rng = random.Random(8)
    texts = ["".join(rng.choices(["a", "b", "é", " ", " ", "\n", "\u2581", "c"], k=rng.randint(0, 12))) for _ in range(400)] + [None, "", " ", "  ", "a", " a", "a ", "a b"]
    bridges = frozenset({"\u2581a", "ab", "bé", "\u2581\u2581"})
    numbering, named = pieces.Numbering(bridges), []
    for i in range(0, len(texts), 50):
        numbers, sizes, new = numbering.add(pa.array(texts[i:i + 50], pa.string()))
        named += new
        ends = np.r_[0, np.cumsum(sizes)]
        for t, a, b in zip(texts[i:i + 50], ends[:-1], ends[1:]):
            assert [named[n] for n in numbers[a:b]] == [p for u in pieces.units_of(t) for p in pieces.cut_unit(u, bridges)]
    assert len(set(named)) == len(named)


def test_replies_are_packed_by_block():
    rng = np.random.default_rng(5)
    n = 2000
    blocks, numbers, sizes = rng.integers(0, 3, n), rng.permutation(n), rng.integers(0, 6, n)
    ids = rng.integers(0, 60_000, sizes.sum())
    ends = np.r_[0, np.cumsum(sizes)]
    rows = pieces._replies(blocks, numbers, sizes, ids)
    assert rows.num_rows == 3 and sum(map(len, rows.column(5).to_pylist())) < 8 * n + 2 * len(ids)
    for block, total, k, data in zip(*(rows.column(i).to_pylist() for i in (0, 2, 4, 5))):
        whole = pieces._unpack(data, 2 * k + total).astype(np.int64)
        cut = np.r_[0, np.cumsum(whole[k:2 * k])] + 2 * k
        got = {int(m): list(whole[a:b]) for m, a, b in zip(np.cumsum(whole[:k]), cut[:-1], cut[1:])}
        assert got == {int(numbers[i]): list(ids[ends[i]:ends[i + 1]]) for i in np.flatnonzero(blocks == block)}
    assert pieces._replies(*(np.zeros(0, np.int64) for _ in range(4))).num_rows == 0


# ---- language model

def test_seating_follows_the_restaurant():
    """Mean tables of one dish of c customers with base 1 is the known expectation of the process."""
    rules = pitman_yor.PitmanYor(discount=0.5, strength=2.0)
    keys = np.arange(1, 20_001, dtype=np.int64) * 7919
    for c in (1, 2, 10, 200):
        tables, _ = pitman_yor.seat(np.full(len(keys), c), np.ones(len(keys)), np.zeros(len(keys)), keys, 0, rules)
        want = 1.0
        for i in range(1, c):
            want += (2 + 0.5 * want) / (2 + i)
        assert abs(tables.mean() - want) < 0.03 * want + 0.02


def test_language_model_base_and_mass(make_docs):
    rng = random.Random(3)
    words = ["The", "of", "and", "mill", "river", "É", "stone"] + [f"rare{i}" for i in range(40)]
    phrases = [f"{a} {b}" for a, b in zip(words, words[1:])]
    rows = [(i, " ".join(rng.choices(phrases, weights=[30, 20, 10, 5, 5, 3, 3] + [1] * 39, k=rng.randint(0, 20)))) for i in range(120)] + [(500, None), (None, "the mill"), (7, rng.choice(words))]
    docs = make_docs(rows, {"score": 1, "word": 2, "n": 3})
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    from topicloom.llm.common import held_out
    model = pitman_yor.train(docs.where(~held_out(7, 2)), pitman_yor.PitmanYor(dishes=6))
    got = pitman_yor.score(docs, model).collect()
    token = lambda t: re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) + [None]
    counts = Counter(w for i, t in rows if not held(i) for w in token(t))
    total, distinct = sum(counts.values()), len(counts)
    want = sorted((i or -1, len(token(t)), sum(counts[w] > 0 for w in token(t)), round(sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in token(t)), 6)) for i, t in rows)
    assert sorted((r.doc_id or -1, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want and {r.train_tokens for r in got} == {total}
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    # all probabilities of a context add up to one, those of the rare words too
    assert np.allclose((10.0 ** model.log_prob.astype(float)).sum(axis=1), 1, atol=1e-5)
    rare = sum(10 ** r.log_rare for r in model.rare.collect()) + 10 ** model.log_unknown
    assert abs(rare - 1) < 1e-9
    unseen = [r for r in got if held(r.doc_id)]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)


def test_language_model_every_word_is_a_context(make_docs):
    """Words beyond the dishes predict what follows them, not what follows any such word."""
    texts = ["a b a b", "b a a b", "b b a a"] * 10 + ["x a", "y b"] * 6 + ["z a b"]
    docs = make_docs(list(enumerate(texts)))
    model = pitman_yor.train(docs, pitman_yor.PitmanYor(dishes=2))
    asked = make_docs([(0, "x a"), (1, "x b"), (2, "y b"), (3, "y a"), (4, "new a"), (5, None)])
    got = {r.doc_id: r.score for r in pitman_yor.score(asked, model).collect()}
    assert got[0] > got[1] + 0.2 and got[2] > got[3] + 0.2
    rare = model.rare.collect()
    assert len(rare) == 3
    for r in rare:  # the dishes after a word, seen and unseen, add up to one
        rest = np.array(r.tail) @ model.roots
        rest[r.dishes] = 10.0 ** np.array(r.logs)
        assert abs(rest.sum() - 1) < 1e-5


def test_language_model_without_training(make_docs):
    docs = make_docs([(1, "a b"), (2, None), (2, None)])
    model = pitman_yor.train(docs.limit(0))
    got = sorted((r.doc_id, r.n_tokens, r.n_known, r.base_score) for r in pitman_yor.score(docs, model).collect())
    assert got == [(1, 3, 0, 0.0), (2, 1, 0, 0.0), (2, 1, 0, 0.0)]
    assert pitman_yor.score(docs.limit(0), model).count() == 0


# ---- chats

TOOLS = [("search", "query", "string", True), ("search", "limit", "integer", False), ("search", "after", "string", False), ("sum", "values", "array", True)]
MESSAGES = "conv_id long, turn long, role string, content string, tool_calls string, tool_call_id string"


def call(i, name="search", **arguments):
    return json.dumps([{"name": name, "id": i, "arguments": arguments}])


def test_chat_cases(spark):
    rows = [
        (1, 0, "user", "find é\n\"x\"", None, None),
        (1, 1, "assistant", None, json.dumps([{"id": "b", "name": "search", "arguments": {"query": "q", "after": "a"}}, {"id": "a", "name": "search", "arguments": {"zeta": 1, "query": 5}}]), None),
        (1, 2, "tool", "ra", None, "a"), (1, 0, "tool", "rb early", None, "b"), (1, 3, "tool", "none", None, "zz"), (1, 4, "tool", "again", None, "a"),
        (2, 0, "assistant", "text too", call("x", after="y"), None), (2, 1, "assistant", None, call("y", after="x", query="q"), None), (2, 2, "tool", None, None, "x"),
        (3, 0, "assistant", None, "not json", None), (3, 1, "assistant", None, call("s", "sum", values=[1, {"b": 1, "a": None}]), None), (3, 2, "assistant", None, call("s", "sum"), None),
        (3, 3, "assistant", None, call("n", "nope"), None), (None, 0, "assistant", None, call("q", query="1", limit=1.5, after="gone"), None), (4, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, MESSAGES).withColumn("status", F.lit("x")).withColumn("row", F.lit(1))
    got = chat.format_chats(df, spark.createDataFrame(TOOLS, "tool string, field string, type string, required boolean")).collect()
    by = {(r.conv_id, r.turn, r.kind, r.call_id): r for r in got}
    a, b = by[1, 1, "call", "a"], by[1, 1, "call", "b"]
    assert a.status == "linked" and a.errors == "type:query,unknown:zeta" and a.json == '{"arguments":{"query":5,"zeta":1},"id":"a","name":"search"}'
    assert b.status == "linked" and (b.order_turn, b.order_level) == (2, 1) and b.errors == ""
    assert (by[1, 0, "result", "b"].order_turn, by[1, 0, "result", "b"].order_level) == (2, 1)
    assert by[1, 3, "result", "zz"].status == "orphan" and by[1, 4, "result", "a"].status == "duplicate"
    assert by[2, 0, "call", "x"].status == by[2, 1, "call", "y"].status == "cycle" and by[2, 0, "call", "x"].errors == "missing:query"
    assert by[3, 1, "call", "s"].json == '{"arguments":{"values":[1,{"a":null,"b":1}]},"id":"s","name":"sum"}' and by[3, 2, "call", "s"].status == "duplicate"
    assert by[3, 3, "call", "n"].errors == "unknown tool" and by[None, 0, "call", "q"].status == "unanswered"
    assert by[None, 0, "call", "q"].errors == "type:limit,reference:after"
    assert by[1, 0, "message", None].json == json.dumps({"content": "find é\n\"x\"", "role": "user"}, ensure_ascii=False, separators=(",", ":"))
    assert by[2, 0, "message", None].status == "message" and (4, None, "message", None) in by
    assert by[3, 0, "message", None].json == '{"role":"assistant"}'  # neither content nor a readable call
    bare = spark.createDataFrame([(1, 0, "assistant", None, "[]", None), (1, 1, "assistant", None, "{", None), (1, 2, "user", "x", "[]", None)], MESSAGES)
    kept = chat.format_chats(bare, spark.createDataFrame(TOOLS, "tool string, field string, type string, required boolean")).collect()
    assert sorted((r.turn, r.kind) for r in kept) == [(0, "message"), (1, "message"), (2, "message")]
    placed = sorted((r for r in got if r.conv_id == 1 and r.status == "linked"), key=lambda r: (r.order_turn, r.order_level, r.order_kind, r.turn))
    assert [(r.kind, r.call_id) for r in placed] == [("call", "a"), ("result", "a"), ("call", "b"), ("result", "b")]
    assert chat.format_chats(df.limit(0), spark.createDataFrame(TOOLS, "tool string, field string, type string, required boolean")).count() == 0


def test_long_chain_is_leveled(spark):
    rows = [(1, i, "assistant", None, call(f"c{i}", query="q", **({"after": f"c{i - 1}"} if i else {})), None) for i in range(150)]
    got = chat.format_chats(spark.createDataFrame(rows, MESSAGES), spark.createDataFrame(TOOLS, "tool string, field string, type string, required boolean"))
    assert [r.order_level for r in got.orderBy("turn").collect()] == list(range(150))


# ---- pipeline

def test_pipeline_against_plain_stages(spark):
    from pathlib import Path
    if not Path("/root/testdata/sf0.001").exists():
        pytest.skip("test tables are not here")
    import corpus_pipeline as pipeline
    from topicloom.llm import language, pii, quality

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    judged = {i: quality.judge(t, quality.LineRules()) for i, t in rows.items()}
    kept = {i: v[9] for i, v in judged.items() if v[6]}
    model = language.train_filter(docs)
    names, scores, _ = language.decide(list(kept.values()), model)
    assert all(n != "und" and s >= 0.5 for n, s in zip(names, scores))
    prints = {i: plain_fingerprint(t, 3) for i, t in kept.items()}
    sets = Sets()
    for a in prints:
        sets.find(a)
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3:
                sets.join(a, b)
    left = {sets.find(i) for i in prints}
    current = docs
    for name, stage in pipeline.STAGES:
        current = pipeline.materialise(stage(spark, current, sf), name)
        if name != "packing":
            assert current.columns == docs.columns
        if name == "quality":
            assert {r.doc_id: r.text for r in current.collect()} == kept
        if name in ("near_duplicates", "personal_data"):
            assert {r.doc_id for r in current.select("doc_id").collect()} == left
        if name == "personal_data":
            assert not any(pii.base_spans(r.text) for r in current.collect())
    packed = current.collect()
    assert {r.doc_id for r in packed} == left and len(packed) == len(left)
    assert Counter((r.doc_id, r.n_tokens) for r in pipeline.run(spark, sf).collect()) == Counter((r.doc_id, r.n_tokens) for r in packed)
