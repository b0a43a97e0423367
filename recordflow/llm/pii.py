"""Personal data: pattern spans, and terms that corpus co-occurrence shows to reveal them; DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordflow.llm.common import bitmap_of, in_bitmap, text_or_empty
from recordflow.runtime import cut_lineage

KINDS = ("email", "ip", "card", "phone", "removed", "general")
CONFIDENCE = 1.64   # square of the normal quantile of the one-sided 90 % bound on an entity given a term
CHANCE = 0.01       # pairs that chance alone may bring up, over all pairs tried
REMOVE_AT = 0.9     # share of an entity's information that a term gives away
GENERALISE_AT = 0.7
# Scripts written without blanks: their terms are pairs of neighbouring characters.
_DENSE = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\u30FC\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]"
_WORD = r"[\p{L}\p{M}\p{N}]++"
# What lies before a term, the term or its first character, and the second one of a pair.
_SCAN = rf"((?:[^\p{{L}}\p{{M}}\p{{N}}]|(?<={_DENSE}){_DENSE}(?!{_DENSE}))*+)({_DENSE}(?=({_DENSE}?))|(?:(?!{_DENSE})[\p{{L}}\p{{M}}\p{{N}}])++)"
_CHUNK = 256        # terms whose places are added up together

# Possessive forms of the kinds' patterns; a run is entered at its start or where the last match ended.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# What a text must hold for its kind to be looked for at all.
_HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]"}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_SPAN = "struct<start:int,kind:int,end:int,value:string>"


def _places(text: Column, pattern: str, kind: int, hint: str | None) -> Column:
    """Leftmost non-overlapping matches as (start, kind, end, value) in code points.

    Each step of the scan takes the gap before a match along, so lengths add up to places.
    """
    scan = rf"(?s)\G(.*?)({pattern})"  # anchored, else a text without a match is scanned from every place
    found = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(scan), F.lit(1)).alias("gap"), F.regexp_extract_all(text, F.lit(scan), F.lit(2)).alias("hit"))
    none = F.array().cast(f"array<{_SPAN}>")

    def step(seen: Column, x: Column) -> Column:
        start = seen["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["hit"].alias("value"))
        return F.struct(end.alias("at"), F.concat(seen["spans"], F.array(span)).alias("spans"))

    spans = F.aggregate(found, F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda seen: seen["spans"])
    return spans if hint is None else F.when(text.rlike(hint), spans).otherwise(none)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        doubled = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 0, doubled).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def base_spans(text: Column) -> Column:
    """E-mail, IP, card and phone spans of a text by start, then kind: an array of (start, kind, end, value).

    Matches that fail their kind's test (parts up to 255; 12 to 19 digits passing Luhn; 9 to 15 digits)
    are dropped without another try.
    """
    def n(value: Column) -> Column:
        return F.length(_digits(value))

    tests = {
        "email": (_EMAIL, None),
        "ip": (_IP, lambda s: s["value"].rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")),
        "card": (_CARD, lambda s: F.when(n(s["value"]).between(12, 19), _luhn(_digits(s["value"]))).otherwise(False)),
        "phone": (_PHONE, lambda s: n(s["value"]).between(9, 15)),
    }
    arrays = []
    for kind, name in enumerate(KINDS[:4]):
        pattern, test = tests[name]
        spans = _places(text, pattern, kind, _HINTS[name])
        arrays.append(spans if test is None else F.filter(spans, test))
    return F.array_sort(F.concat(*arrays))


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _without_spans(text: Column, spans: Column) -> Column:
    """The text with blanks in the place of its spans, so that all other places stay as they are."""
    def step(done: Column, s: Column) -> Column:
        start, end = F.greatest(done["at"], s["start"]), F.greatest(done["at"], s["end"])
        parts = F.array(F.substring(text, done["at"] + 1, start - done["at"]), F.repeat(F.lit(" "), end - start))
        return F.struct(end.alias("at"), F.concat(done["parts"], parts).alias("parts"))

    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    masked = F.aggregate(spans, first, step, lambda done: F.concat(
        F.array_join(done["parts"], ""), F.substring(text, done["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, masked).otherwise(text)


def _has_dense(text: Column) -> Column:
    """Whether a text holds a script without blanks; all of them lie beyond U+0DFF, which is asked first."""
    return text.rlike(r"[\x{E00}-\x{10FFFF}]") & text.rlike(_DENSE)


def terms(text: Column) -> Column:
    """The terms of a whole text, in lower case: runs of letters, marks and digits of any length."""
    plain = F.transform(F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)), F.lower)
    paired = F.zip_with(
        F.regexp_extract_all(text, F.lit(_SCAN), F.lit(2)), F.regexp_extract_all(text, F.lit(_SCAN), F.lit(3)),
        lambda hit, after: F.lower(F.concat(hit, after)))
    return F.when(_has_dense(text), paired).otherwise(plain)


def term_places(text: Column, wanted: Callable[[Column], Column] | None = None) -> Column:
    """``terms`` as (start, end, term) in code points; of those alone that are ``wanted``, if it is given.

    A term ends where the gaps and terms up to it end. Lengths are taken of chunks, then inside the
    chunk of a wanted term, so terms that nobody wants cost no more than a look at them.
    """
    none = F.array().cast("array<struct<start:int,end:int,term:string>>")

    def matches(pattern: str, *groups: int | None) -> Column:
        names = zip(("whole", "hit", "after"), groups)
        return F.struct(*[(F.lit(None).cast("array<string>") if g is None else F.regexp_extract_all(text, F.lit(pattern), F.lit(g))).alias(n) for n, g in names])

    found = F.when(_has_dense(text), matches(_SCAN, 0, 2, 3)).otherwise(matches(rf"[^\p{{L}}\p{{M}}\p{{N}}]*+({_WORD})", 0, 1, None))

    def after(x: Column, i: Column) -> Column:
        return F.coalesce(F.get(x["after"], i - 1), F.lit(""))

    def term(x: Column, i: Column) -> Column:
        return F.lower(F.concat(F.get(x["hit"], i - 1), after(x, i)))

    def chunks(x: Column) -> Column:
        def reach(k: Column, i: Column) -> Column:
            return F.length(F.array_join(F.slice(x["whole"], k, i - k + 1), ""))

        def place(k: Column, i: Column) -> Column:
            end = reach(k, i)
            return F.struct((end - F.length(F.get(x["hit"], i - 1))).alias("start"), (end + F.length(after(x, i))).alias("end"), term(x, i).alias("term"))

        def chunk(k: Column) -> Column:
            last = F.least(k + (_CHUNK - 1), F.size(x["whole"]))
            numbers = F.sequence(k, last)
            if wanted is not None:
                numbers = F.filter(numbers, lambda i: wanted(term(x, i)))
            return F.struct(reach(k, last).alias("at"), F.transform(numbers, lambda i: place(k, i)).alias("places"))

        return F.transform(F.sequence(F.lit(1), F.size(x["whole"]), F.lit(_CHUNK)), chunk)

    def moved(parts: Column) -> Column:
        before = F.aggregate(parts, F.array(F.lit(0)), lambda at, c: F.concat(at, F.array(F.element_at(at, -1) + c["at"])))
        return F.flatten(F.zip_with(parts, F.slice(before, 1, F.size(parts)), lambda c, at: F.transform(c["places"], lambda s: F.struct(
            (s["start"] + at).alias("start"), (s["end"] + at).alias("end"), s["term"].alias("term")))))

    return _with(found, lambda x: F.when(F.size(x["whole"]) > 0, _with(chunks(x), moved)).otherwise(none))


def _among(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows whose term may be among the wanted ones, and all whose term is; of a fixed size, so no row moves."""
    bits = bitmap_of(wanted.select(F.xxhash64("term").alias("key")), "key")
    return in_bitmap(rows, F.xxhash64("term"), bits, "_may").where("_may").drop("_may")


def revealing_terms(found: DataFrame, remove_at: float = REMOVE_AT, generalise_at: float = GENERALISE_AT) -> DataFrame:
    """(term, kind) of the terms that give an entity away, from (unit, entities, masked).

    Counts are of different texts (``unit``), over all rows: n_c with the entity, n_ct with both, N in all; n_t, with
    the term, counts the texts with both and every row with the term alone. So copies of a text with an entity are
    one case, and copies elsewhere speak against a term. A term must pass two tests. Chance: with the text's share of the corpus q = n_c / N, more
    if its texts are longer than others, C(n_t, n_ct) q^n_ct bounds the probability of meeting so often by
    chance; over all pairs tried it may add up to ``CHANCE``. So a word that stood once beside an address tells
    nothing, as every text has such words. Disclosure: the share of the entity's information that the term
    gives away, 1 + log P / log(N / n_c), with the lower confidence bound of n_ct / n_t for P. From
    ``remove_at`` on the term is removed (kind 4), from ``generalise_at`` on it is generalised (kind 5).

    Entities of the same texts are judged as one. A pair is made only if the term is rare enough to reach
    ``generalise_at`` were all its texts the entity's.
    """
    sizes = found.select("unit", F.length("masked").alias("n")).groupBy("unit").agg(F.max("n").alias("n")).agg(
        F.count("*").alias("texts"), F.avg("n").alias("length")).first()
    texts, length = sizes["texts"], max(sizes["length"] or 0.0, 1.0)

    def held_terms(rows: DataFrame) -> DataFrame:
        return rows.select("unit", F.explode(F.array_distinct(terms(F.col("masked")))).alias("term"))

    # Stored, so that the counts of all terms are combined before any are looked up.
    seen = cut_lineage(held_terms(found).groupBy("term").agg(F.count("*").alias("n_rows")).where("n_rows > 1"), "term-counts")
    named = found.where(F.size("entities") > 0)
    held = named.select("unit", F.length("masked").alias("n"), F.explode("entities").alias("entity")).distinct()
    alike = held.groupBy("entity").agg(
        F.count("*").alias("n_c"), F.avg("n").alias("n"), F.bit_xor(F.col("unit")).alias("a"), F.bit_xor(F.xxhash64("unit", F.lit(1))).alias("b")
    ).where((F.col("n_c") > 1) & (F.col("n_c") < texts))

    def limit(n_c: Column) -> Column:
        return (n_c + CONFIDENCE) * F.pow(F.lit(float(texts)) / n_c, F.lit(1 - generalise_at))

    groups = alike.groupBy("a", "b", "n_c").agg(F.avg("n").alias("n"))
    chance = F.least(F.col("n_c") / texts * F.greatest(F.col("n") / length, F.lit(1.0)), F.lit(1.0))
    groups = groups.select("a", "b", "n_c", chance.alias("q"), limit(F.col("n_c")).alias("most"))
    copies = named.groupBy("unit").agg(F.count("*").alias("copies"))
    classes = cut_lineage(
        held.join(alike.select("entity", "a", "b"), "entity").select("unit", "a", "b").distinct().join(groups, ["a", "b"]).join(copies, "unit"), "classes")
    most = classes.groupBy("a", "b").agg((F.max("most") + F.sum("copies")).alias("rows")).agg(F.max("rows")).first()[0] or 0.0
    rare = seen.where(F.col("n_rows") <= most)
    beside = _among(held_terms(named).distinct(), rare).join(rare, "term")
    pairs = cut_lineage(
        beside.join(classes, "unit").groupBy("a", "b", "n_c", "q", "most", "term", "n_rows")
        .agg(F.count("*").alias("n_ct"), F.sum("copies").alias("rows_ct"))
        .withColumn("n_t", F.col("n_ct") + F.col("n_rows") - F.col("rows_ct")).where((F.col("n_t") <= F.col("most")) & (F.col("n_t") > 1)), "pairs")
    tried = max(pairs.count(), 1)
    n, k = F.col("n_t"), F.col("n_ct")
    ways = F.least(k * (1 + F.log(n / k)), F.when(n > k, (n - k) * (1 + F.log(n / (n - k)))).otherwise(0.0))  # bounds log C(n, k)
    surprising = ways + k * F.log("q") + F.log(F.lit(float(tried))) <= F.log(F.lit(CHANCE))
    p = k / n
    spread = F.sqrt(CONFIDENCE * (p * (1 - p) / n + CONFIDENCE / (4 * n * n)))
    bound = (p + CONFIDENCE / (2 * n) - spread) / (1 + CONFIDENCE / n)
    share = 1 + F.log(bound) / F.log(F.lit(float(texts)) / F.col("n_c"))
    return cut_lineage(
        pairs.where(surprising).select("term", share.alias("share")).where(F.col("share") >= generalise_at).groupBy("term").agg(F.max("share").alias("share"))
        .select("term", F.when(F.col("share") >= remove_at, 4).otherwise(5).alias("kind")), "revealing")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, row, unit, all_spans.

    ``spans`` lists kind:start:end of the base spans and of the terms to remove or generalise, by start,
    then kind. Places are code points of the whole text, null texts are empty. A revealing term is
    listed wherever it stands outside base spans, with or without the entity it reveals in the text. Rows
    that repeat are judged each; an empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(f"`{text}`").alias("text"))
    spanned = rows.select("doc_id", "text", F.xxhash64("text").alias("unit"), base_spans(F.col("text")).alias("spans"))
    found = cut_lineage(spanned.select(
        F.expr("uuid()").alias("row"), "doc_id", "unit", "spans", _without_spans(F.col("text"), F.col("spans")).alias("masked"),
        F.array_distinct(F.transform("spans", lambda s: F.concat_ws(":", s["kind"].cast("string"), F.lower(s["value"])))).alias("entities")), "spans")
    flagged = revealing_terms(found.select("unit", "entities", "masked"))
    # Which rows hold a revealing term is asked first; places are looked for in those alone.
    met = _among(found.select("row", F.explode(F.array_distinct(terms(F.col("masked")))).alias("term")), flagged).join(flagged, "term")
    kinds = cut_lineage(met.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("term", "kind"))).alias("kinds")), "term-hits")
    listed = F.transform(
        term_places(F.col("masked"), lambda term: F.map_contains_key("kinds", term)),
        lambda p: F.struct(p["start"].alias("start"), F.try_element_at("kinds", p["term"]).alias("kind"), p["end"].alias("end"), p["term"].alias("value")))
    added = cut_lineage(found.select("row", "masked").join(kinds, "row").select("row", listed.alias("more")), "term-spans")
    every = F.array_sort(F.concat("spans", F.coalesce("more", F.array().cast(f"array<{_SPAN}>"))))

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    return found.drop("masked", "entities").join(added, "row", "left").select("doc_id", "row", "unit", F.col("spans").alias("base"), every.alias("all_spans")).select(
        "doc_id", *map(count, range(4)), F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _listed(F.col("all_spans")).alias("spans"), "row", "unit", "all_spans")


def sanitised(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text) with personal data and revealing terms taken out.

    Base spans become their kind in brackets, terms to generalise ``[term]``, terms to remove nothing;
    overlapping spans are cut out together under the first one's name. Rows equal in id and text give one row.
    """
    found = personal_data(docs, id_col, text).dropDuplicates(["doc_id", "unit"]).select(F.col("doc_id").alias("found_id"), "unit", "all_spans")
    body = text_or_empty(f"`{text}`")
    rows = docs.select(F.col(id_col).alias("doc_id"), body.alias("text"), F.xxhash64(body).alias("key")).dropDuplicates(["doc_id", "key"])
    names = F.array(*[F.lit(x) for x in ("[email]", "[ip]", "[card]", "[phone]", "", "[term]")])

    def step(done: Column, s: Column) -> Column:
        gap = F.substring("text", done["at"] + 1, s["start"] - done["at"])
        new = F.struct(s["end"].alias("at"), F.concat(done["out"], gap, F.element_at(names, s["kind"] + 1)).alias("out"))
        longer = F.struct(F.greatest(done["at"], s["end"]).alias("at"), done["out"].alias("out"))
        return F.when(s["start"] >= done["at"], new).otherwise(longer)

    clean = F.aggregate("all_spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step,
                        lambda done: F.concat(done["out"], F.substring("text", done["at"] + 1, F.length("text"))))
    joined = rows.join(found, F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("key") == F.col("unit")))
    return joined.select("doc_id", clean.alias("text"))


def digest(docs: DataFrame) -> DataFrame:
    """``personal_data`` without its internal columns."""
    return personal_data(docs).drop("row", "unit", "all_spans")
