"""Byte-level BPE, spelling variants and the conversation trie against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm import bpe, conversation_trie, spelling
from quire.llm.queries import ORACLES, QUERIES
from tests.llm.conftest import ODD_DOCS
from tests.oracle import compare, duck

SF = "/root/testdata/sf0.01"
EMPTY = hashlib.sha256(b"").hexdigest()


@pytest.mark.parametrize("name", ["op12_spelling_variants", "op13_conversation_trie"])
def test_queries_equal_their_twins(spark, name):
    ok, rows, _, note = compare(spark, duck(SF), SF, QUERIES[name], ORACLES[name])
    assert ok and rows > 200, note


# Byte-level BPE.


@pytest.fixture(scope="module")
def coder():
    import tiktoken

    data, pattern = bpe.rank_file()
    vocabulary = bpe.Vocabulary(data)
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=vocabulary.ranks, special_tokens={})
    return bpe.Encoder(vocabulary, pattern), own.encode_ordinary


def random_texts():
    rng = random.Random(11)
    parts = ["a", "b", "the", " ", "  ", "'", "ll", "'s", "\n", "é", "東", "京", "0", "٣", "́", "‍", "😀", "　", "\x1c", "\x85", "ſ", "½", "ⅷ", "ก", "ั", "\U0003fc3f", "՘"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 120))) for _ in range(1500)]
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    return texts + ["".join(map(chr, rng.choices(points, k=40))) for _ in range(500)]


LONG = ["x" * 30_000, "東京" * 4_000, " " * 3_000 + "a", "ab'll " * 4_000, "\n \n" * 2_000, "<|endoftext|> and more"]


def test_ids_equal_the_library(coder):
    encoder, want = coder
    texts = random_texts() + LONG
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert ids.tolist() == want(text), text[:80]
        raw, places = encoder.vocabulary.decode(ids.astype(np.int64))
        assert raw.tobytes() == text.encode() and places[-1] == len(raw)


def test_windows_and_forgetting_do_not_show(coder, monkeypatch):
    encoder, want = coder
    monkeypatch.setattr(bpe, "WINDOW", 16)
    monkeypatch.setattr(bpe, "MAX_PIECES", 20)
    small = bpe.Encoder(encoder.vocabulary, encoder.pattern.pattern)
    texts = random_texts()[::5] + LONG[3:]
    assert all(ids.tolist() == want(text) for text, ids in zip(texts, small.encode(texts), strict=True))
    assert len(small.known) < 200


def test_both_trees_merge_alike(coder):
    vocabulary = coder[0].vocabulary
    rng = random.Random(3)
    pieces = [bytes(rng.choices(b"etainos r\xc3\xa9", k=rng.randint(2, 64))) for _ in range(400)]
    for piece, ids in zip(pieces, bpe.merge_rows(pieces, vocabulary), strict=True):
        assert ids.tolist() == bpe.merge_long(piece, vocabulary).tolist()


def test_encoding_of_odd_rows(coder, odd_docs, no_docs):
    rows = bpe.encoding_digest(odd_docs).collect()
    want = Counter()
    for i, text in ODD_DOCS:
        ids = coder[1](text or "")
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()] += 1
    assert Counter(map(tuple, rows)) == want
    kept = bpe.decode(bpe.encode(odd_docs, ids="spans"), ids="spans", out="key")
    assert sorted(kept.columns) == sorted(odd_docs.columns)
    assert all(bytes(r.key).decode() == (r.text or "") for r in kept.collect())
    assert bpe.encoding_digest(no_docs).count() == 0


def test_ids_that_are_none(spark, coder):
    odd = spark.createDataFrame([(1, None), (2, []), (3, coder[1]("a b"))], "n long, ids array<int>")
    assert {r.n: bytes(r.decoded) for r in bpe.decode(odd).collect()} == {1: b"", 2: b"", 3: b"a b"}
    with pytest.raises(ValueError):
        coder[0].vocabulary.decode(np.array([60_000]))


# Spelling variants.


def brute_words(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(counts):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        if best is not None and counts[best] >= 5 * counts[w]:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, form.get(w), root(w), counts[w], len(near[w]), counts[form[w]] if w in form else None) for w in counts}


def word_docs():
    rng = random.Random(5)
    stems = ["".join(rng.choices("abé", k=rng.randint(5, 8))) for _ in range(60)]
    chain = ["aaaaaa" + "b" * k for k in range(7)]  # each a form of the next longer one
    words = stems + [s + rng.choice("abc") for s in stems] + [s[:3] + rng.choice("abÿ×") + s[4:] for s in stems]
    rows = [(i, " ".join(rng.choices(words, k=60))) for i in range(60)]
    # Each link of a chain is five times as frequent as the one before; equal counts go to the smaller word.
    rows += [(200 + k, f"{w}, " * 5 ** (k + 1)) for k, w in enumerate(chain[:5])]
    return rows + [(300, "zzzzzzz " * 5 + "zzzzzza zzzzzzb " * 25), (300, "again again again REPEAT repeat Repeat rePEAT repeat"), (301, "École École École École École école"), (None, "nullid " * 6)]


@pytest.mark.parametrize("block", [1024, 3])
def test_variants_equal_brute_force(docs_of, monkeypatch, block):
    monkeypatch.setattr(spelling, "BLOCK", block)
    rows = word_docs()
    got = [tuple(r) for r in spelling.spelling_variants(docs_of(rows)).collect()]
    want = brute_variants(brute_words(rows))
    assert len(got) == len(set(got)) and set(got) == want
    assert any(form and root != form for _, form, root, *_ in want)


def test_half_keys_share_whatever_is_near(spark):
    rng = random.Random(2)
    words = sorted({"".join(rng.choices("ab", k=rng.randint(6, 9))) for _ in range(300)})
    keys = {r.word: {tuple(k) for k in r.k} for r in spark.createDataFrame([(w,) for w in words], "word string").select("word", spelling.halves(F.col("word")).alias("k")).collect()}
    for a in words:
        for b in words:
            if one_edit(a, b):
                assert keys[a] & keys[b]
                found = [spelling.near_tile([a], [b], kind, n)[0, 0] for n, kind, half in keys[a] & keys[b]]
                assert sum(found) == 1


def test_variants_of_odd_rows(odd_docs, no_docs):
    got = {tuple(r) for r in spelling.spelling_variants(odd_docs).collect()}
    assert got == brute_variants(brute_words(ODD_DOCS))
    assert spelling.spelling_variants(no_docs).count() == 0


# Conversation trie.


def brute_trie(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [v[2:] for v in sorted(v)] for c, v in convs.items()}
    rebuilt = {}
    for c, v in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = tuple(turns.get(c - c % 5, [])[:h] + v[h:])
    members = defaultdict(list)
    for c, v in rebuilt.items():
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
    children, leaves, saved = Counter(p[:-1] for p in members if p), Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    out = Counter()
    for p, m in members.items():
        ids = ",".join(str(c) for c in sorted(m) if len(rebuilt[c]) == len(p))
        out[min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(ids.encode()).hexdigest()] += 1
    return out


def trie_rows(df, **options):
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return Counter(map(tuple, conversation_trie.conversation_trie(df, **options).select(*cols).collect()))


TURN = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
    *[T.StructField(c, T.StringType()) for c in ("key", "node", "depth", "n")],
])


def turn_table(spark, rows):
    return spark.createDataFrame([(*r, *["extra"] * 4) for r in rows], TURN).repartition(4)


def talk_rows():
    rng = random.Random(8)
    rows = []
    for c in range(-12, 160):
        first = rng.choice(["hello", "hello", "hi", ""])
        n = rng.choice([0, 1, 2, 3, 6, 30])
        rows += [(c, t, rng.choice(["user", "bot"]) if t else "user", first if t == 0 else rng.choice(["yes", "nö", "東京"])) for t in range(n)]
    rows += [(c, t, "user", f"deep {t}") for c in (1000, 1001, 1005) for t in range(60)]
    rows += [(c, t, "user", "copy") for c in range(2000, 2400) for t in range(3)]
    rows += [(3000, None, None, None), (3000, None, None, None), (3000, 0, "a", "b"), (3001, 0, "ab", ""), (3002, 0, "", "ab"), (None, 0, "user", "nobody"), (None, None, None, None)]
    return rows + [(3004, 0, "user", "alone")]


@pytest.mark.parametrize("tree_bytes", [conversation_trie.TREE_BYTES, 100, 3000])
def test_trie_equals_brute_force(spark, tree_bytes):
    rows = talk_rows()
    assert trie_rows(turn_table(spark, rows), tree_bytes=tree_bytes) == brute_trie(rows)


def test_trie_of_one_and_of_none(spark):
    rows = [(7, 0, "user", "text")]
    assert trie_rows(turn_table(spark, rows)) == brute_trie(rows)
    # The head of the family is absent and the conversation's own turn falls away: only the root is left.
    rows = [(c, 0, "user", "text") for c in range(5) if zlib.crc32(str(c).encode()) % 9 and c][:1]
    assert trie_rows(turn_table(spark, rows)) == brute_trie(rows) and len(brute_trie(rows)) == 1
    assert sum(trie_rows(turn_table(spark, [])).values()) == 0


def test_ranges_of_ends_do_not_show(spark):
    ids = random.Random(4).sample(range(-50, 5000), 700)
    convs = spark.createDataFrame([(bytes([i % 3]), i) for i in ids], "node binary, conv_id long").repartition(5)
    for size in (1, 7, 10_000):
        got = {bytes(r.node): r.ends_sha256 for r in conversation_trie.ends(convs, size).collect()}
        assert got == {bytes([k]): hashlib.sha256(",".join(str(i) for i in sorted(ids) if i % 3 == k).encode()).hexdigest() for k in range(3)}


def test_node_layouts_grow():
    tree = conversation_trie.Tree()
    keys = [bytes([b]) + b"x" * 23 for b in range(256)]
    random.Random(1).shuffle(keys)
    kinds = set()
    for i, key in enumerate(keys):
        tree.insert(key, 1, i)
        kinds.add(tree.root.kind)
        assert all(tree.root.child(k[0]) is not None for k in keys[: i + 1])
    assert kinds == {4, 16, 48, 256}
    # A key that ends where another goes on, and one that forks inside a turn.
    tree.insert(keys[0] + b"y" * 24, 2, 5)
    tree.insert(keys[0][:5] + b"z" * 19, 1, 6)
    rows = list(tree.nodes())
    assert len(rows) == 1 + 256 + 2 and rows[-1][2:5] == (0, 259, 0) and rows[-1][6] == 257
