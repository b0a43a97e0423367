"""The operators of recordflow.llm against plain versions, on small and odd tables."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from compare import differences, duck
from recordflow import runtime
from recordflow.llm import bpe_chunks, common, exact_dedup, graph, line_dedup, mixing, pii, plans, quality, simhash, topk, toxicity, url_filter

DOCS = "doc_id long, text string, source string, fingerprint string, _maybe int, score double"
SPEC = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def docs(spark):
    long_text = "".join(f"w{i % 977} " for i in range(30_000)) + "x" * 20_000
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
    rows = [(1, base), (2, base), (3, base + " pi"), (4, None), (5, ""), (6, " \n\t "), (7, long_text), (8, long_text + "y"),
            (9, "Mail a@b.com_x@d.e or +1 (555) 123-4567, 1.2.3.4.5, 4111 1111 1111 1111 😀 q@w.co"),
            (None, base), (11, "<|endoftext|>x <|STARTOFTEXT|> it's İ Été\u0085z"), (11, "<|endoftext|>x <|STARTOFTEXT|> it's İ Été\u0085z"),
            (12, "one two three four five\none two three four five six\n\nONE  two three four five")]
    return spark.createDataFrame([(i, t, None if i == 3 else f"s{(i or 0) % 3}", "f", 1, 0.5) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_sql(spark, sf_dir, name):
    found = differences(plans.QUERIES[name](spark, sf_dir), duck(sf_dir), plans.ORACLE[name])
    assert found is None, found


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (6, 6), (None, 1), (1, 2)] + [(100 + i, 101 + i) for i in range(40)] + [(7, 200 + i) for i in range(50)]
    found = dict(graph.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect())
    assert {found[k] for k in (1, 2, 3)} == {1} and found[5] == found[4] == 4 and 6 not in found
    assert {found[100 + i] for i in range(41)} == {100} and {found[200 + i] for i in range(50)} == {7}


def test_url_aliases(spark):
    pages = spark.createDataFrame([
        (1, "http://Bad.net/a", ""), (2, "http://good.com/b", "<LINK rel='canonical' title='a>b' href='http://bad.net/a#x'>"),
        (3, "http://x.org/fr/1", ""), (4, "http://y.com/c", '<meta http-equiv="refresh" content="0; url=http://bad2.net/z">'),
        (5, "http://y.com/d", '<link href="/c" rel=canonical><link rel="canonical" href="http://x.org/fr/1">'),
        (6, None, None), (7, "no scheme", "<link rel=canonical href=/q>"), (8, "http://example.net/en/k?q#f", "")], "page_id long, url string, html string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages).collect()}
    assert got[1] == ("bad.net", "/a", "net/", "block") and got[2][3] == "block"
    assert got[3][2:] == ("org/fr/", "allow") and got[4][3] == "allow" and got[5][3] == "allow"
    assert got[6] == ("", "", None, "allow") and got[7][:2] == ("", "") and got[8] == ("example.net", "/en/k", "example.net/en/", "allow")


def test_bpe(docs, empty):
    spec = bpe_chunks.tokenizer_spec(SPEC)
    tokenizer, wanted = Tokenizer.from_str(spec), Counter()
    for r in docs.collect():
        ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        wanted[(r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in bpe_chunks.encode_decode(docs, spec).collect()) == wanted
    assert bpe_chunks.encode_decode(empty, spec).count() == 0


def test_chunks_are_whole_and_bounded():
    data = np.random.default_rng(1).integers(0, 256, 200_000, dtype=np.uint8).tobytes()
    parts = bpe_chunks.chunks(data)
    assert b"".join(parts) == data and max(map(len, parts)) <= bpe_chunks.LONGEST
    assert len(set(parts) & set(bpe_chunks.chunks(b"shift" + data))) > len(parts) * 0.8


def test_line_dedup(spark, docs, empty, sf_dir):
    table = docs.select("doc_id", "text").where("doc_id is not null").distinct().unionByName(
        spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id") + 1000, "text").toDF("doc_id", "text"))
    lines = sorted((r["doc_id"], i, frozenset(x.split())) for r in table.collect()
                   for i, x in enumerate((r["text"] or "").encode().lower().split(b"\n")) if x.split())
    first = {}
    for d, i, s in lines:
        first.setdefault(s, (d, i))
    links = {s: [t for t in first if t is not s and 5 * len(s & t) >= 4 * len(s | t)] for s in first}
    removed, count = defaultdict(list), Counter()
    for d, i, s in lines:
        match = min([first[s], *[first[t] for t in links[s]]])
        count[d] += len(links[s])
        if (d, i) > match:
            removed[d].append(f"{i}>{match[0]}:{match[1]}")
    for r in line_dedup.line_matches(table).collect():
        assert (r["removed"], r["n_links"], r["n_removed"]) == (",".join(removed[r["doc_id"]]), count[r["doc_id"]], len(removed[r["doc_id"]]))
    kept = {r["doc_id"]: r["text"] for r in line_dedup.without_repeats(docs).collect()}
    assert kept[12] == "one two three four five\n" and kept[5] == ""
    assert line_dedup.line_matches(empty).count() == 0
    shared = spark.createDataFrame([(1, "a b c d e"), (2, "one two three four five\nkeep me safe here now"), (2, "precious text of another row\none two three four five"),
                                    (1, "one two three four five"), (None, "a b c d e")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["text"]) for r in line_dedup.without_repeats(shared).collect()) == [
        (0, "a b c d e"), (1, ""), (1, "one two three four five"), (2, "keep me safe here now"), (2, "precious text of another row")]


def test_exact(docs, empty):
    got = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_duplicates(docs, bucket_keys=2).collect()}
    assert {(1, 2, 3, False), (2, 2, 3, True), (None, 2, 3, False), (4, 5, 2, False), (5, 5, 2, True), (11, 11, 2, True)} <= got
    stays = exact_dedup.keep_last(docs, bucket_keys=2)
    assert stays.columns == docs.columns and sorted(r["doc_id"] for r in stays.collect()) == [2, 3, 5, 6, 7, 8, 9, 11, 12]
    assert exact_dedup.exact_duplicates(empty).count() == 0 and exact_dedup.keep_last(empty).count() == 0


def test_mixing(spark, docs, empty, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = mixing.mix(table, block=32, shard=64).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(table, block=32, shard=64).collect()))
    assert all(r["taken"] <= 2 * r["size"] and r["target"] <= 2 * r["source_size"] for r in rows)
    assert sum({(r["source_size"], r["target"]) for r in rows} and [r["taken"] for r in rows]) == pytest.approx(1.5 * sum(r["size"] for r in rows), rel=0.05)
    source, taken, target = {r["doc_id"]: r["source"] for r in table.collect()}, Counter(), {}
    for r in rows:
        taken[source[r["doc_id"]]] += r["taken"]
        target[source[r["doc_id"]]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= max(0.15 * target[s], 200) for s in target)
    words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in mixing.mixed_documents(table, block=32, shard=64).collect())
    assert words == sum(r["taken"] for r in rows)
    odd = mixing.mix(docs).collect()
    assert len(odd) == docs.count() and all(r["taken"] <= 2 * r["size"] for r in odd)
    assert mixing.mixed_documents(docs).columns == docs.columns
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


def _broadcast_keys(df):
    """Names of the keys by which the run plan of ``df`` joins with a broadcast side."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return [re.findall(r"(\w+)#", keys) for keys in re.findall(r"BroadcastHashJoin \[(.*?)\]", plan)]


def test_mixing_sends_no_slots_or_pieces_to_the_driver(spark, monkeypatch):
    texts = [(i, " ".join(["w"] * (40 + 60 * i)), f"s{i % 2}") for i in range(20)] + [(20, None, None), (None, "one two", "s1"), (21, "", "s0")]
    table = spark.createDataFrame(texts, "doc_id long, text string, source string")
    stored = []

    def kept(df, label="step"):
        stored.append((label, df))
        return runtime.cut_lineage(df, label)

    monkeypatch.setattr(mixing, "cut_lineage", kept)
    rows, cut = mixing.mix(table, block=4, shard=16), mixing.mixed_documents(table, block=4, shard=16)
    runs = [df for label, df in stored if label == "mix-runs"]
    assert len(runs) == 1
    for df in [rows, *runs]:
        assert not [k for k in _broadcast_keys(df) if "block" in k]
    assert not [k for k in _broadcast_keys(runs[0]) if "offset" in k] and _broadcast_keys(cut) == []
    taken = {r["doc_id"]: r["taken"] for r in rows.collect()}
    words = Counter()
    for r in cut.collect():
        words[r["doc_id"]] += len(r["text"].split())
    assert {i: n for i, n in taken.items() if n} == words and sum(words.values()) > 1_000


def test_draw_with_many_small_sources(spark):
    rng = random.Random(3)
    wanted = {1: 200_000 * 0.1, **{r: 2.0 for r in range(2, 302)}, **{r: rng.random() * 4 for r in range(302, 400)}}
    blocks = {1: 200_000, **{r: 1 for r in range(2, 302)}, **{r: 2 for r in range(302, 400)}}
    sources = spark.createDataFrame(
        [(f"s{r}", r, 1.0, blocks[r] * 128, wanted[r] * 128) for r in wanted], "source string, rank long, weight double, source_size long, target double")
    rows = [tuple(r) for r in mixing.draw(sources).collect()]
    taken, places = Counter(r[1] for r in rows), {(r, p, b) for _, r, p, b in rows}
    assert len(places) == len(rows) and all(0 <= b < blocks[r] and 0 <= p < 2 for r, p, b in places)
    assert all(taken[r] == 2 for r in range(2, 302)) and taken[1] == 20_000
    assert all(int(w) <= taken[r] <= int(w) + 1 for r, w in wanted.items()) and abs(len(rows) - sum(wanted.values())) <= 1
    assert {r for r in taken if (r, 1, 0) in places and (r, 0, 0) not in places} == set()
    sizes = Counter(r[0] for r in rows)
    assert len(sizes) == 6 and min(sizes.values()) > 3_000 and max(sizes.values()) < 4_096
    assert rows and sorted(rows) == sorted(map(tuple, mixing.draw(sources).collect()))


def _base(text):
    def luhn(s):
        return sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if c > "4" else int(c) * 2) for i, c in enumerate(reversed(s))) % 10 == 0

    def n(v):
        return len(re.sub("[^0-9]", "", v))

    kinds = [(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
             (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(x) <= 255 for x in v.split("."))),
             (r"[0-9]([\x20-]?[0-9])+", lambda v: 12 <= n(v) <= 19 and luhn(re.sub("[^0-9]", "", v))),
             (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 9 <= n(v) <= 15)]
    return sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(kinds) for m in re.finditer(p, text) if ok(m[0]))


def test_pii(spark, docs, empty, sf_dir):
    revealing = [(2000 + i, f"{'blah ' * i}Contact Zorblax at boss@corp.org now") for i in range(5)]
    others = [(3000 + i, f"ordinary words contact now number {i}") for i in range(60)]
    table = docs.select("doc_id", "text").unionByName(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).unionByName(
        spark.createDataFrame(revealing + others, "doc_id long, text string"))
    texts = defaultdict(list)
    for r in table.collect():
        texts[r["doc_id"]].append(r["text"] or "")
    for r in pii.digest(table).collect():
        options = []
        for t in texts[r["doc_id"]]:
            spans = _base(t)
            listed = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans)
            options.append((hashlib.sha256(listed.encode()).hexdigest(), *[sum(x[1] == k for x in spans) for k in range(4)]))
        assert (r["base_sha256"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) in options
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(table).where("doc_id >= 2000").collect()}
    assert clean[2000] == "Contact  at [email] now" and clean[3001] == others[1][1]
    assert pii.digest(empty).count() == 0


def test_pii_of_rare_entities(spark):
    """A word beside an address of one text tells nothing; one that recurs with an address of two texts does."""
    planted = [(1, "please call Quillfeather at only@one.org or write"), (2, "please ask Bramblewick for in.two@two.org again"),
               (3, "please tell Bramblewick that in.two@two.org failed")]
    others = [(10 + i, f"please call or write at once, ask again and tell us for what that failed number {i}") for i in range(200)]
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(spark.createDataFrame(planted + others, "doc_id long, text string")).collect()}
    assert clean[1] == "please call Quillfeather at [email] or write"
    assert clean[2] == "please ask [term] for [email] again" and clean[3] == "please tell [term] that [email] failed"
    assert all(clean[i] == t for i, t in others)


def test_pii_leaves_clean_documents_of_the_given_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = pii.digest(table.unionByName(table)).collect()  # copies are one text
    assert not [r for r in rows if r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] == 0 and r["spans"]]


def test_pii_terms_against_counted_pairs(spark):
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(5, 60))) + f" u{i}" for i in range(600)]
    for e in range(12):
        for _ in range(rnd.randint(1, 8)):
            i = rnd.randrange(600)
            texts[i] += f" p{e}@x.org" + "".join(f" {t}{e}" for t in ("name", "city") if rnd.random() < 0.9)
    for _ in range(10):
        texts[rnd.randrange(600)] += f" city{rnd.randrange(12)}"
    texts += texts[:50]
    held = {}
    for t in set(texts):
        spans = _base(t)
        masked = t
        for start, _, end in spans:
            masked = masked[:start] + " " * (end - start) + masked[end:]
        held[t] = ({t[x:y] for x, _, y in spans}, set(masked.split()), len(masked))
    n, mean = len(held), np.mean([x[2] for x in held.values()])
    with_term, classes = defaultdict(set), defaultdict(set)
    for t, (entities, terms, _) in held.items():
        for w in terms:
            with_term[w].add(t)
        for e in entities:
            classes[e].add(t)
    rows_with = Counter(w for t in texts for w in held[t][1])
    pairs = []
    for members in {frozenset(m) for m in classes.values() if 1 < len(m) < n}:
        n_c = len(members)
        q = min(1.0, n_c / n * max(1.0, np.mean([held[t][2] for t in members]) / mean))
        most = (n_c + pii.CONFIDENCE) * (n / n_c) ** (1 - pii.GENERALISE_AT)
        for w in {w for t in members for w in held[t][1]}:
            both = with_term[w] & members
            n_t = len(both) + rows_with[w] - sum(texts.count(t) for t in both)
            if rows_with[w] > 1 and 1 < n_t <= most:
                pairs.append((w, n_c, q, n_t, len(both)))
    best = {}
    for w, n_c, q, n_t, k in pairs:
        ways = min(k * (1 + np.log(n_t / k)), (n_t - k) * (1 + np.log(n_t / (n_t - k))) if n_t > k else 0.0)
        z, p = pii.CONFIDENCE, k / n_t
        low = (p + z / (2 * n_t) - np.sqrt(z * (p * (1 - p) / n_t + z / (4 * n_t * n_t)))) / (1 + z / n_t)
        if ways + k * np.log(q) + np.log(len(pairs)) <= np.log(pii.CHANCE):
            best[w] = max(best.get(w, 0), 1 + np.log(low) / np.log(n / n_c))
    wanted = {w: 4 if x >= pii.REMOVE_AT else 5 for w, x in best.items() if x >= pii.GENERALISE_AT}
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = defaultdict(set)
    for r in pii.personal_data(rows).select("all_spans").collect():
        for x in r["all_spans"]:
            if x["kind"] > 3:
                spans[x["value"]].add(x["kind"])
    assert len(wanted) > 3 and {w: {k} for w, k in wanted.items()} == dict(spans)


def test_pii_terms_of_whole_texts(spark):
    filler = "plain filler words that every text holds " * 20
    planted = [(200 + i, f"Kim {filler}x9@far.org {filler}号 王小 Ab7 {filler * 10}Kim {i}") for i in range(6)] + [(2, f"{filler}kim stands here without it, 王小 too")]
    table = spark.createDataFrame(planted
                                  + [(300 + i, f"{filler}{filler}stands here without it, too {i}") for i in range(400)], "doc_id long, text string")
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(table).collect()}
    assert not re.search("(?i)kim|ab7|王小|号", clean[200] + clean[2])
    assert all(clean[300 + i] == f"{filler}{filler}stands here without it, too {i}" for i in range(400))
    text = "É 王小明 a1😀b " + "word " * 1000 + "明"
    places = spark.createDataFrame([(text,)], "t string").select(pii.term_places(F.col("t")), pii.terms(F.col("t"))).first()
    assert all(text[p["start"]:p["end"]].lower() == p["term"] for p in places[0]) and [p["term"] for p in places[0]] == places[1]
    assert places[1] == ["é", "王小", "小明", "a1", "b", *["word"] * 1000, "明"]


def test_classifiers(spark, docs, empty):
    good = ["A calm sentence number %d. You are an honest reader and more words of many lengths." % i for i in range(300)]
    bad = ["BUY!! NOW!! %d!! BUY!! NOW!! CHEAP!!" % i for i in range(300)]
    rude = ["A calm sentence number %d. You are an honest idiot reader and more words of many lengths." % i for i in range(300)]
    texts = good + bad + rude
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 300 or i >= 600), int(i >= 600)) for i in range(900)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    right = [r["predicted"] == int(r["doc_id"] < 300 or r["doc_id"] >= 600) for r in quality.quality(table, labels).collect() if r["held_out"]]
    assert len(right) > 100 and np.mean(right) > 0.95
    model = toxicity.fit(table, labels)
    assert "idiot" in model.similarity.landmarks
    right = [r["predicted"] == int(r["doc_id"] >= 600) for r in toxicity.toxicity(table, labels).collect() if r["held_out"]]
    assert len(right) > 100 and np.mean(right) > 0.95
    assert (model.scores(["what an i d i o t", "i.d.i.o.t!", "an id-iot", "x" * 5000 + " idiott"]) > 0.3).all()
    assert (model.scores(["", "nothing here"]) < 0.5).all()
    for op in (quality.quality, toxicity.toxicity):
        assert op(docs, labels).count() == docs.count() and op(empty, labels).count() == 0 and op(docs, labels.where("false")).count() == docs.count()
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_kernel_against_enumerated_subsequences():
    def plain(a, b):
        def spans(w):
            found = Counter()
            for at in itertools.combinations(range(len(w)), toxicity.LENGTH):
                found["".join(w[i] for i in at)] += toxicity.DECAY ** (at[-1] - at[0] + 1)
            return found
        x, y = spans(a), spans(b)
        return sum(v * y[k] for k, v in x.items())

    words = ["loser", "looser", "closer", "aaaa", "abcabc", "xyz", "réeuxpa", "los"]
    for a in words:
        for b in words:
            codes = toxicity._codes([a], 8, -1), toxicity._codes([b], 8, -2)
            assert float(toxicity.subsequence_kernel(*codes)[0]) == pytest.approx(plain(a, b), rel=1e-4)
    for landmarks in (["loser", "abcabc"], ["los-", "réeux-"]):
        got = toxicity.Similarity(landmarks).of(words)
        for w, row in zip(words, got):
            for mark, value in zip(landmarks, row):
                bare = mark.rstrip("-")
                cut = w[:len(bare) + 1] if mark.endswith("-") else w
                own = plain(cut, cut) * plain(bare, bare)
                full = plain(cut, bare) / own ** 0.5 if own else 0.0
                few = len(set(cut) & set(bare)) < 0.75 * len(set(bare))
                assert value == pytest.approx(0.0 if few or full < toxicity.FLOOR else full ** toxicity.POWER, abs=1e-4)


def test_insults_that_are_stems_of_a_rare_language(spark):
    rng = random.Random(4)
    ends = ["".join(rng.choice("abdefgiklmnorstuvz") for _ in range(rng.randint(2, 4))) for _ in range(60)]

    def text(stem, times):
        words = [rng.choice(["dro", "kel", "mus", "tan", "gro"]) + rng.choice(ends) for _ in range(60)]
        for _ in range(times):
            words[rng.randrange(60)] = stem + rng.choice(ends)
        return " ".join(words) + "."

    rows = [(i, text("grobix", 4), 1) for i in range(100)] + [(i, text("grobix", i % 9 == 0), 0) for i in range(100, 600)]
    rows += [(i, text("tan", 3) + " You idiot.", 1) for i in range(600, 1000)] + [(i, text("tan", 3), 0) for i in range(1000, 2000)]
    table = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    found = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity(table, labels).collect() if r["held_out"]}
    stems, clean = [found[i] for i, t, y in rows if i in found and i < 100], [found[i] for i, t, y in rows if i in found and y == 0]
    assert np.mean(stems) > 0.9 and np.mean(clean) < 0.03
    assert np.mean([found[i] for i, t, y in rows if i in found and 600 <= i < 1000]) > 0.95


def test_disguised_insults():
    landmarks = ["clown", "idiot", "loser", "moron", "scum", "stupid", "trash"]
    model = toxicity.ToxicityModel(toxicity.Similarity(landmarks), np.ones(len(landmarks)), -0.5, np.array([10.0, 0.0, 0.0]), 0.0)
    hidden = ["idxixot", "ixdxixoxt", "stuxpxid", "moxrxon", "m0r0n", "sc*m", "scxum", "tr*sh", "cl0wn", "lo5er", "1d10t", "i*d*i*o*t"]
    hidden += ["x".join(w) for w in landmarks] + [w[:i] + c + w[i + 1:] for w in landmarks for i in range(1, len(w) - 1) for c in "*0"]
    assert (model.scores([f"you are a {w}!" for w in hidden] + [f"({w}), he said. A calm line" for w in hidden]) >= 0.5).all()
    clean = ["crown", "flown", "lower", "moon", "studio", "trait", "patio", "12345", "s-1", "1a2b3c4", "2024-12-01", "*****", "i'd", "to 1 d 1 0 t"]
    assert (model.scores([f"this is a {w} of ours" for w in clean]) < 0.5).all()
    assert model.similarity.sums("an id-iot")[0].tolist() == model.similarity.sums("an idiot")[0].tolist()


def _fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum((n * 2 > len(shingles)) << b for b, n in enumerate(ones))


def test_simhash(spark, docs, empty, sf_dir):
    table = docs.select("doc_id", "text").where("doc_id is not null").distinct().unionByName(
        spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id") + 1000, "text").toDF("doc_id", "text"))
    prints = {r["doc_id"]: _fingerprint(r["text"]) for r in table.collect()}
    parent = {d: d for d in prints}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    got = {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(table).collect()}
    assert got == {(d, f"{f:016x}", root(d)) for d, f in prints.items()}
    kept = simhash.keep_one(table.withColumn("_gone", F.lit(1)))
    assert {r["doc_id"] for r in kept.collect()} == {root(d) for d in prints} and kept.columns == ["doc_id", "text", "_gone"]
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0
    assert simhash.near_duplicates(docs).count() == docs.count()


def test_simhash_keys_are_not_broadcast(spark):
    values = spark.range(200).select(F.xxhash64("id").alias("fingerprint")).unionByName(
        spark.range(200).select(F.xxhash64("id").bitwiseXOR(F.lit(5)).alias("fingerprint")))
    found = simhash.links(values)
    assert _broadcast_keys(found) == [] and found.count() == 200


def test_simhash_links_are_all_found(spark):
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(0, 1 << 63, 40)]
    values = {b ^ sum(1 << int(i) for i in rng.choice(63, n, replace=False)) for b in base for n in range(8)}
    wanted = {(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 4}
    got = [tuple(r) for r in simhash.links(spark.createDataFrame([(v,) for v in values], "fingerprint long")).collect()]
    assert set(got) == wanted and len(got) == len(wanted)


def test_topk(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(0, 40, 6)], 1) for i in range(300)]
    rows += [(i + 300, rows[i][1], 1) for i in range(20)] + [(400, None, 1), (450, [1.0, None], 1), (500, [float("nan")] * 6, 1), (None, [1.0] * 6, 1), (550, [3.0, 4.0], 1), (50, rows[50][1], 2), (100, [2.0, -90.0, 7.5, 0.0, 3.0, 1.0], 3)]
    got = sorted(tuple(r) for r in topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int"), query_block=3).collect())
    whole = [(i, np.floor(256 * np.array(v)).astype(np.int64)) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all()]
    wanted = []
    for n, (q, x) in enumerate(whole):
        if q % 50 == 0:
            near = sorted((-int(x @ v), i) for m, (i, v) in enumerate(whole) if m != n and len(v) == len(x))[:5]
            wanted += [(q, rank + 1, i, -score) for rank, (score, i) in enumerate(near)]
    assert got == sorted(wanted) and len([w for w in wanted if w[0] == 100]) == 10
    assert topk.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_pipeline(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf_dir)
        assert after.columns == docs.columns
        docs = after
    tokenizer, wanted = Tokenizer.from_file(SPEC), Counter()
    for r in docs.collect():
        wanted[(r["doc_id"], len(tokenizer.encode(r["text"], add_special_tokens=False).ids))] += 1
    assert Counter((r["doc_id"], r["n_tokens"]) for r in rows) == wanted


def test_places_of_wanted_terms(spark):
    texts = ["É 王小明 a1😀b " + "word " * 700 + "明 b", "Kim " + "x İy\n" * 400 + "kim!", "", "kim", "  ", "王小明"]
    table = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in table.select("t", pii.term_places(F.col("t")), pii.term_places(F.col("t"), lambda x: x.isin("kim", "b", "小明"))).collect():
        assert r[2] == [p for p in r[1] if p["term"] in ("kim", "b", "小明")] and all(r[0][p["start"]:p["end"]].lower() == p["term"] for p in r[2])
        assert len(r[2]) == len(re.findall(r"(?i)\bkim\b|\bb\b|小明|(?<=😀)b", r[0]))


def test_encoder_keeps_words_in_use(monkeypatch):
    monkeypatch.setattr(bpe_chunks, "MEMO_BYTES", 40_000)
    encoder, seen, plain = bpe_chunks.Encoder(bpe_chunks.tokenizer_spec(SPEC)), Counter(), Tokenizer.from_file(SPEC)

    class Counting:
        def encode_batch_fast(self, words, **options):
            seen.update(words)
            return plain.encode_batch_fast(words, **options)

    encoder.tokenizer = Counting()
    for n in range(60):
        texts = [["often", f"w{n}x{i}"] for i in range(20)] + [[]]
        for words, ids in zip(texts, encoder.ids([[w.encode() for w in t] for t in texts])):
            assert np.frombuffer(ids, "<u4").tolist() == plain.encode(" ".join(words), add_special_tokens=False).ids
            assert encoder.decode(ids).decode() == plain.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)
    assert seen["often"] == 1 and len(encoder.memo) + len(encoder.older) < 300


def test_texts_are_judged_in_slices(spark):
    table = spark.range(3_000).selectExpr("id doc_id", "if(id % 7 = 0, null, concat('text ', id)) text").coalesce(1)
    sizes = common.by_text(table, "text", "n", "long", lambda texts: [len(found := list(texts))] * len(found))
    rows = sizes.collect()
    assert len(rows) == 3_000 and max(r["n"] for r in rows) <= 500 and sizes.columns == ["doc_id", "text", "n"]
    assert {(r["doc_id"], r["text"]) for r in rows} == {(r["doc_id"], r["text"]) for r in table.collect()}


def test_line_groups_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "BLOCK", 4)
    base = [f"word{i}" for i in range(20)] + ["é" * 20, "a\0b", "x" * 40]
    rows = [(i, " ".join(base[:i % 23] + [f"own{i}"] + base[i % 23:]) + ("\n" + " ".join(base) if i % 3 else "")) for i in range(70)] + [(None, " ".join(base).upper())]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    sets = [(d, i, frozenset(x.split())) for d, t in rows for i, x in enumerate(t.encode().lower().split(b"\n"))]
    distinct = {s for *_, s in sets}
    links = {s: sum(t != s and 5 * len(s & t) >= 4 * len(s | t) for t in distinct) for s in distinct}
    wanted = Counter()
    for d, _, s in sets:
        wanted[d] += links[s]
    got = line_dedup.line_matches(table).collect()
    assert {r["doc_id"]: r["n_links"] for r in got} == wanted and max(wanted.values()) > 70
    assert all(r["removed"] == ("" if r["doc_id"] is None else "0>null:0,1>null:0" if r["doc_id"] % 3 else "0>null:0") for r in got)


def test_words_in_bulk():
    texts = [b"One\ttwo  one\r\n\n THREE \x0b" + b"y" * 31 + b" " + b"y" * 32 + b" " + b"y" * 33, b"", "été ÉtÉ".encode(), b"\n", b"last one"]
    lines, hashes, first = line_dedup._words(texts)
    wanted = [(n, w) for n, line in enumerate(b"\n".join(texts).lower().split(b"\n")) for w in line.split()]
    assert lines.tolist() == [n for n, _ in wanted] and first.tolist() == [0, 3, 4, 5, 7, 8]
    assert len(set(zip(hashes.tolist(), [w for _, w in wanted]))) == len(set(hashes.tolist())) == len({w for _, w in wanted})


def test_quality_fit_gathers_totals_only(spark, monkeypatch):
    texts = ["A calm sentence number %d, with words." % i if i % 2 else "BUY!! NOW!! %d!! BUY!!" % i for i in range(400)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, quality int")
    few, kind, gathered = quality.fit(table, labels), type(table), []

    def collect(frame, plain=kind.collect):
        rows = plain(frame)
        gathered.append(sum(len(v) for r in rows for v in r if isinstance(v, bytes | bytearray)))
        return rows

    monkeypatch.setattr(kind, "collect", collect)
    monkeypatch.setattr(quality, "_PARTS", 40)
    many = quality.fit(table, labels)
    size = quality.FEATURES + 1
    assert sum(gathered) == 8 * size * (size + 1)
    assert np.allclose(many.weights, few.weights) and np.allclose(many.scores(texts), few.scores(texts)) and few.weights.any()


def test_long_lines_of_other_words_are_no_candidates():
    draw = random.Random(3)
    one = [f"v{draw.randrange(10**6)}" for _ in range(126)]
    texts = [" ".join([*one[:8], *(f"{i}w{n}" for n in range(118))]) for i in range(40)] + [" ".join(one), " ".join([*one[3:], "new"])]
    lines = line_dedup.Lines([t.encode() for t in texts], np.ones(line_dedup.BUCKETS, np.uint32))
    n = len(texts)
    columns = [np.zeros(n, np.int64), lines.key, lines.size << 32 | 2, *np.atleast_2d(lines.parity), np.full(n, -1)]
    batch = line_dedup.pa.RecordBatch.from_arrays([line_dedup.pa.array(c) for c in columns], names=list("abcdef")[:len(columns)])
    assert [(i.tolist(), j.tolist()) for i, j in line_dedup._candidates(batch)] == [([40], [41])]
    for i, j in itertools.combinations(range(n), 2):
        differ = len(set(texts[i].split()) ^ set(texts[j].split()))
        assert sum(np.bitwise_count((half[i] ^ half[j]).view(np.uint64)) for half in np.atleast_2d(lines.parity)) <= differ
