"""Multiset fingerprints, the prefix trie and the manifest against plain versions: whole tables, odd rows, and parts that only large inputs reach."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumentrace.llm import merkle_manifest, multiset_hash, prefix_trie, queries

SF = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- fingerprints ---


def plain_pieces(text):
    end, space = r"\n.!?;:|", r" \t\n\x0b\f\r"
    return re.findall(f"[^{end}]{{1,48}}[^{end}{space}]{{0,48}}[{end}]*[{space}]*|[{end}]+[{space}]*", text)


def plain_sums(text):
    sums, n = [0] * 240, 0
    for p in plain_pieces(text):
        n += 1
        for part in range(4):
            bits = int(sha(p)[15 * part : 15 * part + 15], 16)
            for shift in range(15):
                for lane in range(4):
                    sums[60 * part + 4 * shift + lane] += bits >> (shift + 15 * lane) & 1
    return n, sums


def plain_print(text):
    n, sums = plain_sums(text)
    words = [sum(sums[i + lane] % 2**14 << 15 * lane for lane in range(4)) for i in range(0, 240, 4)]
    return "".join(f"{w:015x}" for w in [n % 2**14, *words])


def plain_likeness(a, b):
    if plain_print(a) == plain_print(b):
        return 1.0
    x, y = ([2 * c - n for c in sums] for n, sums in map(plain_sums, (a, b)))
    size = (sum(i * i for i in x) * sum(i * i for i in y)) ** 0.5
    return max(0.0, sum(i * j for i, j in zip(x, y, strict=True)) / size) if size else 0.0


def plain_edits(docs):
    ids = sorted(docs, reverse=True)
    return {d: docs[d][: len(docs[d]) - len(docs[d]) // 3] + docs[e][: len(docs[d]) // 3] for d, e in zip(ids, ids[1:] + ids[:1], strict=True)}, dict(zip(ids, ids[1:] + ids[:1], strict=True))


def test_fingerprints_of_the_whole_table(spark):
    docs = dict(duckdb.sql(f"select doc_id, coalesce(text, '') from '{SF}/documents.parquet'").fetchall())
    got = {r.doc_id: r for r in queries.op11_multiset_hash(spark, SF).collect()}
    edits, after = plain_edits(docs)
    assert set(got) == set(docs)
    for d, t in docs.items():
        r = got[d]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(t), sha(edits[d]), plain_print(t), plain_print(edits[d]))
        assert r.near_edited == pytest.approx(plain_likeness(t, edits[d])) and r.near_next == pytest.approx(plain_likeness(t, docs[after[d]]))
    long = [r for r in got.values() if r.n_chars > 600]
    assert sum(r.near_edited > r.near_next for r in long) > 0.95 * len(long)


def test_ranges_meet_their_neighbours(spark, monkeypatch):
    """Ids with gaps in more ranges than rows: every row has the next one, and the last the first."""
    monkeypatch.setattr(multiset_hash, "RANGES", 20)
    rnd = random.Random(3)
    docs = {i: f"text {i}. " * (i % 7) for i in rnd.sample(range(-(10**12), 10**12), 150)}
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(5)
    edits, _ = plain_edits(docs)
    assert {r.doc_id: r.edited for r in multiset_hash.fingerprinted(frame).select("doc_id", "edited").collect()} == edits


def test_fingerprints_of_odd_rows(spark):
    schema = "doc_id long, text string, vector string, next string, range int"
    rows = [(1, "b\nc", "x", "y", 1), (1, "a b.", "x", "y", 1), (None, None, "x", "y", 1), (2, "", "x", "y", 1), (2, "", "x", "y", 1), (7, "😀é" * 90, "x", "y", 1)]
    got = multiset_hash.fingerprinted(spark.createDataFrame(rows, schema)).select("doc_id", "n_chars", "edited", "near_edited", "near_next", multiset_hash.printed(F.col("vector")).alias("v")).collect()
    order = [(7, "😀é" * 90, ""), (2, "", ""), (2, "", "a b."), (1, "a b.", "b\nc"), (1, "b\nc", ""), (None, "", "😀é" * 90)]
    want = Counter((d, len(t), t[: len(t) - len(t) // 3] + n[: len(t) // 3], plain_print(t)) for d, t, n in order)
    assert Counter((r.doc_id, r.n_chars, r.edited, r.v) for r in got) == want
    assert all(r.near_edited == 1 for r in got if not r.n_chars)
    assert multiset_hash.fingerprinted(spark.createDataFrame([], schema)).collect() == []
    one = multiset_hash.fingerprinted(spark.createDataFrame([(4, "abcdef. abcdef.")], "doc_id long, text string")).first()
    assert one.edited == "abcdef. ab" + "abcde" and one.near_next == 1


def test_pieces_join_and_sums_add_up(spark):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("ab .\n!?;|\té東 ") for _ in range(rnd.choice([0, 1, 5, 300]))) for _ in range(60)] + ["x" * 500, "a b " * 100, " ", "...", "a.b" * 9000]
    frame = spark.createDataFrame([(t, texts[i - 1]) for i, t in enumerate(texts)], "a string, b string")
    v = {c: multiset_hash.fingerprint(F.col(c)) for c in "ab"}
    both = multiset_hash.summed(F.concat(multiset_hash.pieces(F.col("b")), multiset_hash.pieces(F.col("a"))))
    added = multiset_hash.inserted(v["a"], v["b"])
    edited = multiset_hash.edited_text(F.col("a"), F.col("b"))
    rows = frame.select(
        "a",
        F.array_join(multiset_hash.pieces(F.col("a")), "").alias("joined"),
        (both == added).alias("sum"),
        (multiset_hash.deleted(added, v["b"]) == v["a"]).alias("difference"),
        (multiset_hash.edited_vector(F.col("a"), v["a"], edited) == multiset_hash.fingerprint(edited)).alias("edit"),
    ).collect()
    assert all(r.joined == r.a and r.sum and r.difference and r.edit for r in rows)


def test_fingerprints_of_texts_that_repeat_a_piece_thousands_of_times(spark):
    """The squares of both lengths fit a word; their product does not."""
    docs = {1: "ok.\n" * 7000 + "end", 2: "ok.\n" * 6000, 3: "a b c"}
    edits, after = plain_edits(docs)
    got = {r.doc_id: r for r in multiset_hash.fingerprinted(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    for d, text in docs.items():
        assert got[d].near_edited == pytest.approx(plain_likeness(text, edits[d]))
        assert got[d].near_next == pytest.approx(plain_likeness(text, docs[after[d]]))


# --- trie ---


def plain_trie(rows):
    of = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            of[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(v)] for c, v in of.items()}
    members, last, own = defaultdict(list), defaultdict(list), {}
    for c in sorted(turns):
        h = zlib.crc32(str(c).encode()) % 4
        path = tuple(turns.get(c - c % 20, [])[:h] + turns[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        last[path].append(c)
    for p, m in members.items():
        own[p] = (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p in members:
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += own[p]
    return {(m[0], len(p)): (members[p[:-1]][0] if p else None, len(m), children[p], leaves[p], saved[p], sha(",".join(map(str, last[p])))) for p, m in members.items()}


def made(nodes):
    rows = nodes.collect()
    out = {(r.conv_id, r.depth): tuple(r)[2:] for r in rows}
    assert len(out) == len(rows)
    return out


def test_trie_of_the_whole_table(spark):
    rows = duckdb.sql(f"select conv_id, turn, role, text from '{SF}/conversations.parquet'").fetchall()
    assert made(queries.op12_prefix_trie(spark, SF)) == plain_trie(rows)


@pytest.mark.parametrize(("members", "queue"), [(1000, 10**6), (3, 2), (12, 1), (1, 5)])
def test_trie_in_shards(spark, members, queue):
    """Shards, a top over them and queues that spill give the totals of one pass; one first turn is in most conversations."""
    rnd, rows = random.Random(members), []
    for c in rnd.sample(range(400), 160):
        for t in range(rnd.choice([1, 2, 3, 5, 9])):
            rows.append((c, t, rnd.choice(["user", "assistant", None]), "hot" if t == 0 else rnd.choice(["a", "b b", None, "c\td e"]), "x", 0))
    rows += [(900 + i, t, "user", f"turn {t} of many", "x", 0) for i in range(3) for t in range(120)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, key string, depth int").repartition(7)
    assert made(prefix_trie.trie(frame, members=members, queue=queue)) == plain_trie(rows)


def test_trie_of_odd_rows(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(5, None, "system", "s"), (5, 2, None, None), (5, 2, None, None), (5, 1, "user", ""), (25, None, None, " a  b "), (None, 1, "user", "lost"), (20, 0, "user", "q"), (-3, 1, "user", "n")]
    assert made(prefix_trie.trie(spark.createDataFrame(rows[:7], schema))) == plain_trie(rows[:7])
    assert made(prefix_trie.trie(spark.createDataFrame(rows, schema)))[(-3, 0)][1] == 4
    assert prefix_trie.trie(spark.createDataFrame([], schema)).collect() == []


def test_spilling_queue():
    rnd, queue, plain, taken = random.Random(2), prefix_trie.SpillingQueue(3), [], []
    for i in range(3000):
        if rnd.random() < 0.6 or not plain:
            order = bytes([rnd.randrange(4), rnd.randrange(256)])
            queue.push(order, (order, i))
            plain.append(order)
        else:
            plain.sort()
            assert queue.least() == plain[0]
            taken.append(queue.pop())
            assert taken[-1][0] == plain.pop(0)
    while queue:
        taken.append(queue.pop())
    assert len({i for _, i in taken}) == len(taken) == queue.count and len(queue.runs) == 0


def test_ends_of_many_conversations(spark, monkeypatch):
    """Ids of one node in many stretches hash as one string."""
    monkeypatch.setattr(prefix_trie, "STRETCH", 40)
    ids = pa.RecordBatch.from_arrays([pa.array([b"a"] * 50 + [b"b"] * 3, pa.binary()), pa.array([*range(50), 1, 2, 3], pa.int64())], names=["key", "conv_id"])
    stretches = list(prefix_trie._stretches(iter([ids.slice(0, 20), ids.slice(20)])))
    assert sum(s.num_rows for s in stretches) > 4
    out = [r for b in prefix_trie._digests(iter(stretches)) for r in b.to_pylist()]
    assert out == [{"key": b"a", "ends_sha256": sha(",".join(map(str, range(50))))}, {"key": b"b", "ends_sha256": sha("1,2,3")}]


# --- manifest ---


def plain_manifest(rows):
    def field(x):
        return "-" if x is None else f"{len(str(x).encode())}:{x}"

    def leaf(r, text):
        return sha("".join(map(field, (r[0], r[2], r[3], r[4], text))))

    def build(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
        return levels

    def climb(levels, at, given):
        proof = ""
        for level in levels[:-1]:
            run, k = level[at // 8 * 8 : at // 8 * 8 + 8], at % 8
            proof += "".join(run[:k] + run[k + 1 :])
            given = sha("".join(run[:k] + [given] + run[k + 1 :]))
            at //= 8
        return proof, given

    langs = defaultdict(list)
    for r in rows:
        langs[(r[3] is not None, (r[3] or "").encode())].append(r)
    names, trees = sorted(langs), {}
    for n in names:
        langs[n].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        trees[n] = build([leaf(r, r[1]) for r in langs[n]])
    top, out = build([trees[n][-1][0] for n in names]), Counter()
    for k, n in enumerate(names):
        for i, r in enumerate(langs[n]):
            text = r[1]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and text is not None:
                text = "".join(x.lower() if "A" <= x <= "Z" else x for x in text)
            below, given = climb(trees[n], i, leaf(r, text))
            above, given = climb(top, k, given)
            out[(r[0], leaf(r, r[1]), trees[n][-1][0], top[-1][0], sha(below + above), given, given == top[-1][0])] += 1
    return out


def test_manifest_of_the_whole_table(spark):
    rows = duckdb.sql(f"select doc_id, text, source, lang, n_chars from '{SF}/documents.parquet'").fetchall()
    got = Counter(map(tuple, queries.op13_merkle_manifest(spark, SF).collect()))
    assert got == plain_manifest(rows) and 0 < sum(v for k, v in got.items() if not k[-1]) < len(rows)


@pytest.mark.parametrize("broadcast", [0, 1 << 20])
def test_manifest_of_trees_of_many_heights(spark, monkeypatch, broadcast):
    """Languages of one to 700 rows, more of them than one run, with and without broadcast ancestors."""
    monkeypatch.setattr(merkle_manifest, "BROADCAST", broadcast)
    rnd, rows = random.Random(8), []
    for lang, n in [("en", 700), (None, 65), ("", 1), ("Zz", 8), ("é", 9), ("𐀀", 2), ("ﬀ", 3), *((f"l{i}", 1) for i in range(70))]:
        rows += [(rnd.randrange(10**9), rnd.choice(["Text A", "b", None, "É"]), rnd.choice(["s", None]), lang, rnd.choice([1, None])) for _ in range(n)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long").repartition(6)
    assert Counter(map(tuple, merkle_manifest.proved(frame).collect())) == plain_manifest(rows)


def test_manifest_of_odd_rows(spark):
    schema = "doc_id long, text string, source string, lang string, n_chars long, tree string, place long, hash string"
    rows = [(1, "A", "s", "en", 1), (1, "A", "s", "en", 1), (None, None, None, None, None), (None, "B", None, None, 0), (2, "", "", "", 0), (1, "C", "s", "en", 1)]
    frame = spark.createDataFrame([(*r, "t", 5, "h") for r in rows], schema)
    assert Counter(map(tuple, merkle_manifest.proved(frame).collect())) == plain_manifest(rows)
    assert merkle_manifest.proved(frame.limit(0)).collect() == []
    alone = merkle_manifest.proved(frame.where("doc_id = 2")).first()
    assert alone.leaf == alone.subroot == alone.root == alone.folded_root and alone.proof_sha256 == sha("") and alone.verified
