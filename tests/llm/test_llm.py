"""Each operator against a plain version on small fixtures with nulls, empty and long texts, ties, repeats and odd columns."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumentrace.llm import bpe, chat_format, embedding_dedup, exact_dedup, minhash_dedup, packing, quality, queries, substring_dedup, suffix_dedup, toxicity, windows
from lumentrace.llm.components import components

public_tokenizers = pytest.importorskip("public_tokenizers")
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, kept string, n long, nodes string"


def frame(spark, texts, parts=3):
    """Texts as documents with columns whose names clash with the operators' own."""
    rows = [(i, t, "x", 7, None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(5)
    words = ["alpha", "Beta", "gamma.", "déjà", "x", "the", "of", "Straße,", "東京", "1999", "!!"]
    say = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    base, passage = [say(rnd.randint(1, 90)) for _ in range(14)], say(40)
    out = [*base, base[3], base[3], base[4] + "  ", base[5].replace(" ", "\t", 3), say(30) + " " + passage + " " + say(9), passage + " " + say(12), passage]
    near = base[6].split() + say(80).split()
    out += [" ".join(near), " ".join([*near[:-1], "end"]), " ".join(near).upper(), None, None, "", " \n", "a", "a a a a a a a a a a a a a a a a a a a a a a a a", "é" * 700, say(3000)]
    return out


def plain(t):
    return t or ""


def test_suffix_dedup(spark, texts):
    width = 40
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(frame(spark, texts), width).collect()}
    seen = Counter(b[i : i + width] for t in texts for b in [plain(t).encode()] for i in range(len(b) - width + 1))
    for d, t in enumerate(texts):
        b = plain(t).encode()
        gone = [False] * len(b)
        for i in range(len(b) - width + 1):
            if seen[b[i : i + width]] > 1:
                gone[i : i + width] = [True] * width
        runs = sum(g and (not i or not gone[i - 1]) for i, g in enumerate(gone))
        assert (got[d].n_bytes, got[d].n_removed, got[d].n_spans, bytes(got[d].kept)) == (len(b), sum(gone), runs, bytes(x for x, g in zip(b, gone) if not g)), t


@pytest.mark.parametrize("batches", [1, 2, 3])
def test_substring_dedup(spark, texts, batches):
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(frame(spark, texts), 8, batches).collect()}
    seen = set()
    for d, t in enumerate(texts):
        w = plain(t).encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - 7):
            key = tuple(w[i : i + 8])
            if key in seen:
                gone[i : i + 8] = [True] * 8
            seen.add(key)
        kept = b" ".join(x for x, g in zip(w, gone) if not g).decode()
        assert (got[d].n_words, got[d].n_removed, got[d].kept) == (len(w), sum(gone), kept), t


def sharing_ids(spark):
    """Documents some of which repeat an id with the same text, with another one, or have none; and their words."""
    rnd = random.Random(21)
    say = lambda n: " ".join(rnd.choice(["ab", "cd", "ef", "gh", "ij", "kl"]) + str(rnd.randint(0, 99)) for _ in range(n))
    a, b, c, d = (say(40) for _ in range(4))
    rows = [(1, a), (1, a), (2, b), (2, c), (None, d), (None, say(30)), (None, None), (None, d), (5, say(9) + " " + c + " " + say(3)), (6, say(25)), (7, d)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_substring_dedup_of_shared_ids(spark):
    rows, docs = sharing_ids(spark)
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring_dedup.remove_repeats(docs, 20).collect())
    want = Counter()
    for i, t in rows:
        w = plain(t).split()
        gone = len(w) if i == 7 else 40 if i == 5 else 0
        want[(i, len(w), gone, " ".join([] if i == 7 else w[:9] + w[49:] if i == 5 else w))] += 1
    assert got == want


def test_suffix_dedup_of_shared_ids(spark):
    rows, docs = sharing_ids(spark)
    got = Counter((r.doc_id, r.n_bytes, bytes(r.kept).decode()) for r in suffix_dedup.remove_repeats(docs, 60).collect())
    once = set((i, plain(t)) for i, t in rows)
    seen = Counter(t[k : k + 60] for _, t in once for k in range(len(t) - 59))
    want = Counter()
    for i, t in ((i, plain(t)) for i, t in rows):
        gone = {x for k in range(len(t) - 59) if seen[t[k : k + 60]] > 1 for x in range(k, k + 60)}
        want[(i, len(t), "".join(x for k, x in enumerate(t) if k not in gone))] += 1
    assert got == want and any(len(k) < n for _, n, k in got)


def test_pipeline_stages_of_shared_ids(spark):
    import corpus_pipeline

    rows, _ = sharing_ids(spark)
    docs = spark.createDataFrame([(i, t, "en", len(plain(t))) for i, t in rows], "doc_id long, text string, lang string, n_chars long").repartition(3)
    told = lambda x: Counter((r.doc_id, r.text, r.n_chars) for r in x.collect())
    cut = told(corpus_pipeline.cut_repeats(spark, docs, ""))
    words = rows[8][1].split()
    new = lambda i, t: "" if i == 7 else " ".join(words[:9] + words[49:]) if i == 5 else t
    assert cut == Counter((i, new(i, t), len(plain(new(i, t)))) for i, t in rows)
    # each text stays once, under the smallest id, and no text goes with another one's copy
    first = {t: (i, t, len(plain(t))) for i, t in reversed(rows)}
    for stage in (corpus_pipeline.drop_copies, corpus_pipeline.drop_near_copies):
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and told(out) == Counter(first.values())


def test_index_compacts_and_opens_again(spark, texts, tmp_path):
    """Five batches in two sessions of an index with a compaction decide what one pass over all decides."""
    path = f"file://{tmp_path}/index"
    index = substring_dedup.FingerprintIndex(spark, 8, max_runs=2, path=path)
    rows = windows.texts_by_id(frame(spark, texts).select("doc_id", "text")).rows
    parts = substring_dedup.in_id_order(rows, 5)
    decided = [index.ingest(p) for p in parts[:3]]
    assert [(low, high) for low, high, _ in index.runs] == [(0, 2)]
    index.close(keep=True)
    # what a compaction cut short would leave, and one whose old runs are still there
    (tmp_path / "index" / "run-0-5-of-4").mkdir()
    index = substring_dedup.FingerprintIndex(spark, 8, max_runs=2, path=path)
    assert [(low, high) for low, high, _ in index.runs] == [(0, 2)] and not (tmp_path / "index" / "run-0-5-of-4").exists()
    decided += [index.ingest(p) for p in parts[3:]]
    got = {r.doc_id: {(x.pos + i) for x in r.spans for i in range(x.n)} for r in index.spans(decided, rows).collect()}
    seen, want = set(), {}
    for d, t in enumerate(texts):
        w = plain(t).split()
        for i in range(len(w) - 7):
            key = tuple(w[i : i + 8])
            if key in seen:
                want.setdefault(d, set()).add(i)
            seen.add(key)
    assert got == want
    index.close()
    assert not list((tmp_path / "index").glob("run-*"))


def thue_morse():
    """Two words of 1,024 bytes whose polynomial hashes modulo 2**64 agree for every odd base."""
    t = [0]
    for _ in range(10):
        t += [1 - x for x in t]
    return "".join("ab"[x] for x in t), "".join("ba"[x] for x in t)


def test_equality_is_not_fooled(spark):
    one, two = thue_morse()
    words = [f"w{i}" for i in range(20)]
    texts = [" ".join([*words[:10], x, *words[11:]]) for x in (one, two)]
    docs = frame(spark, texts)
    assert [r.component_id for r in minhash_dedup.grouped(docs, 3, 85).orderBy("doc_id").collect()] == [0, 1]
    assert [r.n_removed for r in substring_dedup.remove_repeats(docs).collect()] == [0, 0]
    assert [r.n_removed for r in suffix_dedup.remove_repeats(docs, 1060).collect()] == [0, 0]
    numbers = minhash_dedup.Shingles(3)
    assert len(np.intersect1d(numbers(texts[0]), numbers(texts[1]))) == 15 and not set(numbers("a b")) & set(numbers("b a"))


def test_near_copies_of_shared_ids(spark):
    rnd = random.Random(3)
    say = lambda: " ".join(f"w{rnd.randint(0, 999)}" for _ in range(60))
    t, u, v = say(), say(), say()
    rows = [(1, t), (1, u), (2, t + " end"), (3, u + " end"), (None, v), (5, v + " end"), (None, v), (6, say())]
    got = Counter((r.doc_id, r.component_id, r.kept) for r in minhash_dedup.grouped(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect())
    assert got == Counter({(1, 1, True): 2, (2, 1, False): 1, (3, 1, False): 1, (None, None, True): 2, (5, None, False): 1, (6, 6, True): 1})


def shingles(t, k):
    w = [bytes(c + 32 if 65 <= c <= 90 else c for c in x) for x in plain(t).encode().split()]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def connected(n, links):
    of = list(range(n))
    for a, b in sorted(links):
        lo, hi = sorted((of[a], of[b]))
        of = [lo if x == hi else x for x in of]
    return of


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80), (1, 60)])
def test_minhash_dedup(spark, texts, k, percent):
    got = {r.doc_id: r for r in minhash_dedup.grouped(frame(spark, texts), k, percent).collect()}
    sets = [shingles(t, k) for t in texts]
    links = [(a, b) for a in range(len(texts)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = connected(len(texts), links)
    assert [(got[d].n_shingles, got[d].component_id, got[d].kept) for d in range(len(texts))] == [(len(sets[d]), want[d], want[d] == d) for d in range(len(texts))]


def test_tiles_of_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "FEW", 1)
    monkeypatch.setattr(minhash_dedup, "TILE", 4)
    rnd = random.Random(9)
    base = [f"w{rnd.randint(0, 9999)}" for _ in range(120)]
    texts = []
    for i in range(24):
        w = list(base)
        for _ in range(rnd.randint(1, 9)):
            w[rnd.randint(0, 119)] = f"n{rnd.randint(0, 999)}"
        texts.append(" ".join(w))
    got = {r.doc_id: r.component_id for r in minhash_dedup.grouped(frame(spark, texts), 3, 85).collect()}
    sets = [shingles(t, 3) for t in texts]
    links = [(a, b) for a in range(24) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    assert [got[d] for d in range(24)] == connected(24, links)


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 1 << 62, 1200).astype(np.uint64)
    a, b = np.sort(pool[:1000]), np.sort(pool[200:])
    full = minhash_dedup.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
    assert abs((full[0] == full[1]).mean() - 800 / 1200) < 0.12
    # every slot holds the least of all permutations' steps, early stop or not
    few = minhash_dedup.signatures(a[:3], np.array([0, 3]))
    assert (few < np.iinfo(np.uint64).max).all()


def test_exact_dedup(spark, texts):
    got = {r.doc_id: r for r in exact_dedup.deduplicate(frame(spark, texts)).collect()}
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", plain(t)) for t in texts]
    first, size = {t: i for i, t in reversed(list(enumerate(norm)))}, Counter(norm)
    for d, t in enumerate(norm):
        assert tuple(got[d]) == (d, first[t], size[t], first[t] == d, hashlib.sha256(t.encode()).hexdigest())


def test_cuckoo_filter_resizes_and_deletes():
    digests = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(3000)]
    bucket = exact_dedup.Bucket({}, cells=4)
    for i, d in enumerate(digests):
        bucket.put(d, i, 1)
    assert bucket.filter.cells >= 1024 and all(bucket.filter.holds(exact_dedup.filter_key(d)) for d in digests)
    for d in digests[::2]:
        bucket.take(d, None, 1)
    assert len(bucket.content) == 1500 and all(bucket.filter.holds(exact_dedup.filter_key(d)) for d in digests[1::2])
    assert sum(bucket.filter.holds(exact_dedup.filter_key(d)) for d in digests[::2]) < 30


def test_index_inserts_deletes_and_grows(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BUCKET_KEYS", 2)
    put = lambda rows: index.insert(exact_dedup.digests(spark.createDataFrame(rows, "doc_id long, text string")))
    told = lambda: {(r.doc_id, r.keep_id, r.group_size) for r in index.groups(index.live()).collect()}
    index = exact_dedup.DedupIndex(spark, 1)
    put([(1, "a"), (2, "a"), (3, "b")])
    put([(4, "a"), (5, "c")])
    assert index.buckets == 2 and told() == {(1, 1, 3), (2, 1, 3), (4, 1, 3), (3, 3, 1), (5, 5, 1)}
    index.delete(spark.createDataFrame([(1,), (3,)], "doc_id long"))
    assert told() == {(2, 2, 2), (4, 2, 2), (5, 5, 1)}
    put([(3, "b"), (None, "a")])
    assert told() == {(2, None, 3), (4, None, 3), (None, None, 3), (5, 5, 1), (3, 3, 1)}
    index.delete(spark.createDataFrame([(None,), (2,), (4,)], "doc_id long"))
    assert told() == {(5, 5, 1), (3, 3, 1)}


def test_packing(spark, texts):
    from tokenizers import Tokenizer

    length = 64
    rows = packing.packed(frame(spark, texts), WORD, length).collect()
    encode = Tokenizer.from_file(WORD).encode
    docs, seqs, pad, total = defaultdict(list), defaultdict(list), 0, 0
    for r in rows:
        docs[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    for d, t in enumerate(texts):
        want = [*encode(plain(t), add_special_tokens=False).ids, 1]
        parts = sorted(docs[d], key=lambda r: r.start)
        assert [r.start for r in parts] == list(np.cumsum([0, *(r.length for r in parts)])[:-1])
        assert b"".join(bytes(r.ids) for r in parts) == struct.pack(f"<{len(want)}I", *want)
        assert {r.doc_tokens for r in parts} == {len(want)}
    for parts in seqs.values():
        parts.sort(key=lambda r: r.offset)
        size = sum(r.length for r in parts)
        assert [r.offset for r in parts] == list(np.cumsum([0, *(r.length for r in parts)])[:-1]) and size <= length
        total, pad = total + size, pad + (0 if size & (size - 1) == 0 else length - size)
    assert pad < 0.15 * total


def test_packing_cuts_are_optimal():
    rng = np.random.default_rng(3)
    at = np.concatenate([[0], np.cumsum(rng.integers(1, 9, 40))])
    cost = rng.choice([0.0, 4.0, 16.0], 41)
    cost[0] = 0
    best = [0.0] + [np.inf] * 40
    for j in range(1, 41):
        tail = j == 40
        for i in range(j):
            size = int(at[j] - at[i])
            if size <= 32:
                best[j] = min(best[j], best[i] + (packing.closing(size, 32)[0] if tail else 32 - size + cost[j]))
    cuts = packing.best_cuts(at, cost, 32, True)
    ends = [0, *cuts]
    known = dict(zip(at.tolist(), cost.tolist(), strict=True))
    whole = [c for c in ends if c in known]
    spent = sum(32 - (b - a) + known[b] for a, b in zip(whole, whole[1:]) if b != at[-1]) + packing.closing(int(at[-1] - whole[-2]), 32)[0]
    assert spent == pytest.approx(best[40])


def test_word_forms_keep_their_ids():
    from tokenizers import Tokenizer

    encode, coder = Tokenizer.from_file(WORD).encode, packing.word_ids(WORD)
    rnd = random.Random(2)
    pool = "aAbé Éİſ̈́  ,.,. \n.\n\t\x85\xa0\x1c's12²Ⅷ中文😀!?$<|endoftext|>K-Σσ"
    for _ in range(3000):
        s = "".join(rnd.choice(pool) for _ in range(rnd.randint(0, 14)))
        s = s[:3] + rnd.choice(["", "<|endoftext|>", "<|ENDOFTEXT|>"]) + s[3:]
        assert packing.tokens_of(s, coder, 1)[0].tolist() == [*encode(s, add_special_tokens=False).ids, 1], s


def test_bpe_equals_library(spark, texts):
    from tokenizers import Tokenizer

    library, mine = Tokenizer.from_file(BYTE), bpe.coder(BYTE)
    rnd = random.Random(1)
    pool = "abcdeéàß tion ing the 's 're  \n\t\x85\xa0\x1c　１２Ⅷ中文кот 😀👍🏽́e!??--__\"'`\x00\x7f"
    odd = ["".join(rnd.choice(pool) for _ in range(rnd.randint(0, 30))) for _ in range(2000)]
    odd += ["".join(chr(rnd.choice([rnd.randint(0, 0xD7FF), rnd.randint(0xE000, 0x10FFFF)])) for _ in range(12)) for _ in range(1000)] + ["a<|endoftext|>b <|endoftext|>", "<|endoftext|>"]
    for s in odd:
        ids = library.encode(s, add_special_tokens=False).ids
        got = mine.encode(s)
        assert np.frombuffer(got, dtype="<u4").tolist() == ids, s
        assert mine.decode(got) == library.decode(ids, skip_special_tokens=False)
    rows = {r.doc_id: r for r in bpe.encoded(frame(spark, texts), BYTE).collect()}
    assert all(rows[d].decoded == plain(t) for d, t in enumerate(texts))


def test_chat_format_round_trip(spark):
    rows = [(1, 0, "us er\n<|im_end|>", "a\\<|b\\\\<\\|"), (1, 1, "assistant", "\\ <|im_start|>assistant"), (1, 2, "assistant", None), (2, 0, None, None), (None, 0, "user", "x")]
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], "conv_id long, turn long, role string, text string, piece string, at int")
    back = {r.conv_id: r for r in chat_format.read_back(chat_format.formatted(chat_format.turn_rows(df))).collect()}
    assert [tuple(t) for t in back[1].turns] == [(r, t or "") for c, _, r, t in rows if c == 1]
    assert back[1].loss_text == "\\ <|im_start|>assistant" and back[None].loss_text == "" and [tuple(t) for t in back[2].turns] == [("", "")]
    assert chat_format.formatted(chat_format.turn_rows(df.limit(0))).count() == 0


def test_chat_layouts(spark):
    import json

    docs = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "r"}]},
        {"conversations": [{"from": "human", "value": "v"}]},
        {"prompt": "p", "response": None},
        {"instruction": "i", "input": "n", "output": "o"},
        {"else": 1},
    ]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)] + [(9, "broken"), (10, None)], "id long, j string")
    got = {r.conv_id: (r.layout, [tuple(t) for t in r.turns]) for r in chat_format.turns_of_json(df, "j", "id").collect()}
    assert got[0] == ("messages", [("user", "q"), ("assistant", "r")]) and got[1] == ("speakers", [("user", "v")])
    assert got[2] == ("prompt and response", [("user", "p"), ("assistant", None)]) and got[3][1] == [("user", "i\n\nn"), ("assistant", "o")]
    assert got[4] == got[9] == got[10] == (None, [])
    # further fields, also in messages, content that is no string, and no messages
    more = ['{"id": 7, "messages": [{"role": "user", "content": "q", "name": "z"}]}', '{"messages": [{"role": "user", "content": [1]}]}', '{"messages": []}', '{"prompt": "p", "response": "r", "system": "s", "n": 1}', '{"messages": "no"}']
    got_more = [(r.layout, [tuple(t) for t in r.turns]) for r in chat_format.turns_of_json(spark.createDataFrame(list(enumerate(more)), "id long, j string").coalesce(1), "j", "id").orderBy("conv_id").collect()]
    assert got_more[0] == ("messages", [("user", "q")]) and got_more[1] == ("messages", [("user", "[1]")]) and got_more[2][0] in ("messages", "messages with text")
    assert got_more[3][1] == [("system", "s"), ("user", "p"), ("assistant", "r")] and got_more[4] == (None, [])
    typed = spark.createDataFrame([(1, "p", "r", 5)], "conv_id long, prompt string, response string, more int")
    assert [tuple(r) for r in chat_format.turn_rows(typed).orderBy("turn").collect()] == [(1, 0, "user", "p"), (1, 1, "assistant", "r")]
    with pytest.raises(ValueError, match="no known layout"):
        chat_format.turn_rows(typed.select("more"))


def test_embedding_dedup(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "TILE", 16)
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((12, 16))
    x = np.concatenate([centres[i % 12] + 0.16 * rng.standard_normal(16) for i in range(150)]).reshape(150, 16)
    x[1] = x[0] * 3
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(150, None), (151, [0.0] * 16), (152, [float("nan")] * 16), (153, [None] * 16), (154, []), (155, x[5].tolist()), (156, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, v int")
    got = {r.vec_id: r for r in embedding_dedup.grouped(df).collect()}
    good = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if v and None not in v and np.isfinite(v).all() and np.linalg.norm(v) > 0}
    links = [(a, b) for a in good for b in good if b < a and len(good[a]) == len(good[b]) and good[a] @ good[b] >= 0.95]
    degree = Counter(i for p in links for i in p)
    want = connected(157, links)
    assert [(got[i].n_links, got[i].component_id, got[i].kept) for i in range(157)] == [(degree[i], want[i], want[i] == i) for i in range(157)]
    assert embedding_dedup.grouped(df.limit(0)).count() == 0


def test_components(spark):
    rnd = random.Random(0)
    links = [(rnd.randint(0, 60), rnd.randint(0, 60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 140)] + [(7, 7)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = connected(200, [p for p in links if p[0] != p[1]])
    assert got == {i: want[i] for p in links if p[0] != p[1] for i in p}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def labelled(spark, word):
    rnd = random.Random(8)
    make = lambda bad: " ".join(rnd.choice(["the", "river", "stone", "green", "walks", "over", *([word] * 2 if bad else [])]) for _ in range(30))
    texts = [make(i % 2) for i in range(400)] + [None, ""]
    labels = spark.createDataFrame([(i, 1 - i % 2, i % 2) for i in range(400)] + [(401, None, None)], "doc_id long, quality int, toxic int")
    return frame(spark, texts), labels


@pytest.mark.parametrize(("module", "parts", "fold"), [(quality, 5, 0), (toxicity, 3, 1)])
def test_classifiers_hold_out(spark, module, parts, fold):
    docs, labels = labelled(spark, "blockhead")
    got = {r.doc_id: r for r in module.classified(docs, labels).collect()}
    assert len(got) == 402 and all(0 <= r.score <= 1 for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % parts == fold) for d, r in got.items())
    truth = (lambda d: 1 - d % 2) if module is quality else (lambda d: d % 2)
    out = [d for d, r in got.items() if r.held_out and d < 400]
    assert np.mean([got[d].predicted == truth(d) for d in out]) > 0.95
    # the held-out rows' labels are no input
    flipped = labels.withColumns({"quality": F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == fold, 1 - F.col("quality")).otherwise(F.col("quality")), "toxic": F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == fold, 1 - F.col("toxic")).otherwise(F.col("toxic"))})
    again = {r.doc_id: r.score for r in module.classified(docs, flipped).collect()}
    assert all(again[d] == pytest.approx(r.score) for d, r in got.items())


@pytest.mark.parametrize("module", [quality, toxicity])
def test_classifiers_without_labels(spark, module):
    docs, labels = labelled(spark, "x")
    assert {round(r.score, 6) for r in module.classified(docs, labels.limit(0)).collect()} == {0.5}


def noisy(spark, size=3000, share=0.85):
    """Documents of eight words, two in five of them junk for label 0 of ``quality`` and one in four for label 1: often in doubt."""
    rnd = random.Random(12)
    good = [rnd.random() < share for _ in range(size)]
    texts = [" ".join(rnd.choice(["blockhead"] * (2 if g else 4) + ["the", "river", "stone", "green", "walks", "over"]) for _ in range(8)) for g in good]
    labels = spark.createDataFrame([(i, int(g), int(not g)) for i, g in enumerate(good)], "doc_id long, quality int, toxic int")
    return frame(spark, texts), labels


@pytest.mark.parametrize(("module", "label", "rows"), [(quality, "quality", (200, 200)), (toxicity, "toxic", (200, 200))])
def test_scores_keep_their_level_when_caps_bind(spark, module, label, rows):
    docs, labels = noisy(spark)
    share = labels.agg(F.avg(label)).first()[0]
    level = lambda model: module.scored(docs, model).agg(F.avg("score")).first()[0]
    assert level(module.model(docs, labels)) == pytest.approx(share, abs=0.05)
    assert level(module.model(docs, labels, rows=rows)) == pytest.approx(share, abs=0.1)


@pytest.mark.parametrize(("module", "label"), [(quality, "quality"), (toxicity, "toxic")])
def test_share_of_one_class_is_that_of_all_labels(spark, module, label):
    docs, labels = noisy(spark, 200)
    one = labels.where(F.col(label) == 0)
    got = module.scored(docs, module.model(docs, one, rows=(10, 10))).first().score
    assert got == pytest.approx(module.scored(docs, module.model(docs, one)).first().score, rel=1e-6)


def test_empty_tables_and_null_ids(spark):
    empty = frame(spark, [])
    odd = spark.createDataFrame([(None, "a b c d e f g h i j"), (3, "a b c d e f g h i j"), (3, "a b c d e f g h i j")], "doc_id long, text string")
    calls = [
        lambda d: suffix_dedup.remove_repeats(d, 8), lambda d: substring_dedup.remove_repeats(d, 4), lambda d: minhash_dedup.grouped(d, 3, 85), exact_dedup.deduplicate,
        lambda d: packing.packed(d, WORD), lambda d: bpe.encoded(d, BYTE),
    ]
    for call in calls:
        assert call(empty).count() == 0
        ids = [str(r.doc_id) for r in call(odd).collect()]
        assert len(ids) >= 3 and set(ids) == {"3", "None"} and ids.count("3") >= 2


def test_features_are_indicators():
    ids = list(quality.features(pa.array(["aa aa", "", None, "aa aa aa"])))
    assert [len(i) > 0 for i in ids] == [True, False, False, True] and 1 in ids[0] and 2 not in ids[0] and 2 in ids[3]


def test_queries_are_registered():
    assert sorted(queries.QUERIES, key=lambda n: int(re.findall(r"\d+", n)[0])) == [n for k in range(1, 14) for n in queries.QUERIES if n.startswith(f"op{k}_")]


def test_packing_capitals_before_marks():
    """Ids of every ASCII capital before every combining mark, and before all characters below them, are the library's."""
    import unicodedata

    from tokenizers import Tokenizer

    after = [chr(c) for c in range(0x110000) if unicodedata.category(chr(c))[0] == "M" or 0x80 <= c < 0x300]
    tokenizer, coder = Tokenizer.from_file(WORD), packing.word_ids(WORD)
    texts = [f"x {chr(c)}{m}y, Z{m} {chr(c)}." for c in range(65, 91) for m in after]
    for text, e in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert packing.tokens_of(text, coder, 1)[0].tolist() == [*e.ids, 1], ascii(text)


def test_tiles_of_many_chunks(spark):
    """Numbers of pairs of chunks are told apart beyond the range of an int."""
    n = 100_000
    pairs = spark.range(0, n, 777).selectExpr("cast(id as int) as own", "cast(99999 - id as int) as other")
    tiles = [(min(r.own, r.other), max(r.own, r.other), r.t) for r in pairs.select("own", "other", embedding_dedup.tile(F.col("own"), F.col("other")).alias("t")).collect()]
    assert len({t for *_, t in tiles}) == len({x[:2] for x in tiles})
