"""Alignment, conversation trie and token counts against plain versions, on small and odd tables."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from recordflow.llm import alignment, bpe_chunks, conversation_trie, token_counts

WORDS = bpe_chunks.tokenizer_spec(public_tokenizers.path("word_bpe_49k.json"))
BYTES = bpe_chunks.tokenizer_spec(public_tokenizers.path("byte_bpe_50k.json"))
with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
    PIECES = f.read()


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    """Odd texts, null and repeated ids, random mixes of blanks and scripts, the given texts; clashing columns."""
    rnd = random.Random(1)
    odd = [None, "", "", " ", "  a  b", "▁x y", "<s> </s> <|endoftext|> <0x41> <|STARTOFTEXT|>", "日本語 テキスト x 漢字 y",
           "a b 　c  d ", "x" * 3_000 + " y " + "z" * 50, "\x00a b\x1cc", "Привет мир как дела " * 40, "é é ﬁ ½ İ ΣΑΣ ς",
           "it's I'LL we've 1234567 😀😀", "aaa aaaa aaaaa", "word " * 30_000 + "q" * 9_000]
    odd += ["".join(rnd.choice("ab 'é日\n\t.1😀<|") for _ in range(rnd.randint(1, 400))) for _ in range(100)]
    rows = [(None if i == 7 else i // 2, t, 1, "r", 2) for i, t in enumerate(odd)]
    given = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id", "text", F.lit(1).alias("n_a"), F.lit("r").alias("row"), F.lit(2).alias("at"))
    return spark.createDataFrame(rows, "doc_id long, text string, n_a int, row string, at int").unionByName(given).cache()


def plain_alignment(rows):
    pair, known, counts = alignment.Pair(BYTES, PIECES), [], Counter()
    for doc, text in rows:
        whole, a, b = " " + (text or ""), [], []
        if text:
            a, b = pair.a.encode(whole, add_special_tokens=False).ids, pair.b.encode(text)
            if not b"".join(pair.bytes_a[i] for i in a) == whole.encode() == b"".join(pair.bytes_b[i] for i in b):
                a, b = [], []
        ends_a, ends_b = (np.cumsum([len(t[i]) for i in ids]) for t, ids in ((pair.bytes_a, a), (pair.bytes_b, b)))
        groups, links, done_a, done_b = [], [], 0, 0
        for end in sorted(set(ends_a.tolist()) & set(ends_b.tolist())):
            to_a, to_b = np.searchsorted(ends_a, end) + 1, np.searchsorted(ends_b, end) + 1
            groups.append(",".join(map(str, a[done_a:to_a])) + "|" + ",".join(map(str, b[done_b:to_b])))
            links.append((a[to_a - 1], b[to_b - 1]))
            done_a, done_b = to_a, to_b
        counts.update(links)
        known.append((doc, len(a), len(b), links, ";".join(groups)))
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return Counter((doc, a, b, len(links), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links),
                    hashlib.sha256(groups.encode()).hexdigest() if links else "") for doc, a, b, links, groups in known)


@pytest.mark.parametrize("size", [(1 << 16, 1 << 10, 16, 1 << 18), (64, 40, 2, 50), (200, 100, 3, 1)])
def test_alignment(docs, monkeypatch, size):
    for name, value in zip(("RANGE", "MARGIN", "FAN_IN", "FREQUENT"), size):
        monkeypatch.setattr(alignment, name, value)
    wanted = plain_alignment([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert Counter(tuple(r) for r in alignment.alignment(docs, BYTES, PIECES).collect()) == wanted


def test_alignment_of_nothing_and_other_tokenizers(docs):
    assert alignment.alignment(docs.where("false"), BYTES, PIECES).count() == 0
    with pytest.raises(ValueError):
        alignment.alignment(docs, WORDS, PIECES)


def test_fragments_compose_alike_in_any_bracketing():
    rnd = random.Random(2)
    for _ in range(200):
        parts = [{"first": rnd.choice([None, i]), "pre_a": [i], "pre_b": [-i] * rnd.randint(0, 2), "suf_a": [], "suf_b": []} for i in range(6)]
        for p in parts:
            if p["first"] is not None:
                p["suf_a"], p["suf_b"] = [100 + p["first"]], [200]
        whole, closed = alignment.compose(parts)
        cut = rnd.randint(1, 5)
        (left, one), (right, two) = alignment.compose(parts[:cut]), alignment.compose(parts[cut:])
        both, three = alignment.compose([left, right])
        assert both == whole and sorted(one + two + three) == sorted(closed)


def test_ranges_cover_the_text(monkeypatch):
    monkeypatch.setattr(alignment, "RANGE", 50)
    monkeypatch.setattr(alignment, "MARGIN", 20)
    data = (" one two three" * 40 + " " + "x" * 300 + " four five" * 30).encode()
    found = list(alignment.ranges(data))
    assert [f[1] for f in found] == [0, *[f[2] for f in found[:-1]]] and found[-1][2] == len(data) and len(found) > 5
    assert all(w <= s < e <= t and data[w:w + 1] == b" " for w, s, e, t in found)


def plain_trie(rows):
    own, built, members, children = defaultdict(list), {}, defaultdict(set), defaultdict(set)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    for conv, mine in turns.items():
        h = zlib.crc32(str(conv).encode()) % 9
        built[conv] = turns.get(conv - int(math.fmod(conv, 5)), [])[:h] + mine[h:]
        for d in range(len(built[conv]) + 1):
            members[tuple(built[conv][:d])].add(conv)
    for path in members:
        if path:
            children[path[:-1]].add(path)
    leaves, saved = Counter(), Counter()
    for path, held in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += not children[path]
            saved[path[:d]] += (len(held) - 1) * len(path[-1][1].encode()) if path else 0
    return Counter((
        min(held), len(path), min(members[path[:-1]]) if path else None, len(held), len(children[path]), leaves[path], saved[path],
        hashlib.sha256(",".join(str(c) for c in sorted(held) if len(built[c]) == len(path)).encode()).hexdigest()) for path, held in members.items())


@pytest.mark.parametrize("component", [4_096, 20])
def test_trie(spark, monkeypatch, component):
    """Nulls, ties, repeated rows, negative ids, copies, one long conversation, clashing columns; heavy components too."""
    monkeypatch.setattr(conversation_trie, "COMPONENT", component)
    monkeypatch.setattr(conversation_trie, "PIECE", 3)
    rnd = random.Random(3)
    rows = [(rnd.choice([None, -7, *range(15), 99]), rnd.choice([None, 0, 1, 2, 3]), rnd.choice([None, "u"]), rnd.choice([None, "", "a", "b", "é"])) for _ in range(150)]
    rows += [(200 + 5 * i, t, "u", f"t{t}") for i in range(30) for t in range(12)] + [(1_000, t, "u", f"x{t % 3}") for t in range(300)]
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, depth int, node int")
    assert Counter(tuple(r) for r in conversation_trie.prefix_trie(table).collect()) == plain_trie(rows)


def test_trie_of_nothing(spark):
    table = spark.createDataFrame([(None, 1, "u", "x")], "conv_id long, turn long, role string, text string")
    assert conversation_trie.prefix_trie(table).count() == 0 and conversation_trie.prefix_trie(table.where("false")).count() == 0


@pytest.mark.parametrize("spec", [WORDS, BYTES], ids=["words", "bytes"])
@pytest.mark.parametrize("size", [4 << 20, 100])
def test_token_counts(docs, monkeypatch, spec, size):
    monkeypatch.setattr(token_counts, "SLICE_BYTES", size)
    tokenizer = Tokenizer.from_str(spec)
    wanted = Counter()
    for r in docs.collect():
        text = r["text"] or ""
        n = len(tokenizer.encode(text, add_special_tokens=False).ids)
        wanted[(r["doc_id"], len(text.encode()), n, n > 50)] += 1
    assert Counter(tuple(r) for r in token_counts.count_tokens(docs, spec, limit=50).collect()) == wanted
    assert token_counts.count_tokens(docs.where("false"), spec).count() == 0


def test_merges_of_a_vocabulary_with_early_later_pairs():
    """A pair whose result takes part in an earlier pair is merged place by place, as the library does."""
    from tokenizers import models

    vocab = {t: i for i, t in enumerate(["a", "b", "c", "bc", "ab", "abc", "aa", "aab"])}
    merges = [("b", "c"), ("ab", "c"), ("a", "bc"), ("a", "b"), ("a", "a"), ("aa", "b"), ("a", "ab")]
    tokenizer = Tokenizer(models.BPE(vocab=vocab, merges=merges))
    counter = token_counts.Merges(tokenizer.to_str())
    assert counter.single.any()
    rnd = random.Random(4)
    texts = ["".join(rnd.choice("abc") for _ in range(rnd.randint(1, 30))) for _ in range(500)]
    assert counter.survivors(texts).tolist() == [len(tokenizer.encode(t).ids) for t in texts]
