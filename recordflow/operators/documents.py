"""Text operators over documents and pages. All are narrow but the label index."""

from __future__ import annotations

from html.entities import html5

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordflow.functions.text import splice
from recordflow.runtime import checked_broadcast, cut_lineage

# What counts as identifying text. Only syntax that common regex engines share.
PII_PATTERNS = {
    "EMAIL": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "PHONE": r"\+?[0-9]{1,3}[ .-]\([0-9]{3}\)[ .-][0-9]{3}[ .-][0-9]{4}|\+[0-9]{1,3}(?:[ .-]?\(?[0-9]{1,4}\)?){2,5}|"
             r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}",
    "IP": r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}",
    "ID": r"[A-Z]{0,4}-?[0-9]{7,}",
}
PII_PATTERN = "|".join(f"(?:{p})" for p in PII_PATTERNS.values())

# The same matches with possessive runs, which only some engines know: a failed run is not retried.
_FAST_PATTERN = PII_PATTERN.replace("[A-Za-z0-9._%+-]+@", "[A-Za-z0-9._%+-]++@", 1)
# Every match holds one of these; texts without any are left alone.
_HINT = r"@|[0-9]{7}|[0-9][ .-]\(|\+[0-9]|[0-9]\)?[ .-][0-9]{3}[ .-][0-9]|[0-9]\.[0-9]{1,3}\.[0-9]"

TOKEN_DIGITS = 12  # of the salted digest in a token; the second of two texts with the same ones gets all 64


def pii_kind(match: Column) -> Column:
    return (
        F.when(match.contains("@"), F.lit("EMAIL")).when(match.rlike(f"^{PII_PATTERNS['IP']}$"), F.lit("IP"))
        .when(match.rlike(f"^{PII_PATTERNS['ID']}$"), F.lit("ID")).otherwise(F.lit("PHONE")))


def pii_token(match: Column, salt: str, digits: int = TOKEN_DIGITS) -> Column:
    """Stable token of an identifying text: its kind and a salted digest."""
    digest = F.substring(F.sha2(F.concat(F.lit(salt), match), 256), 1, digits)
    return F.concat(F.lit("["), pii_kind(match), F.lit("_"), digest, F.lit("]"))


def pseudonymize(docs: DataFrame, text: str, salt: str, out: str = "masked", keys: DataFrame | None = None) -> DataFrame:
    """Add the text with e-mails, phone numbers, addresses of machines and long numbers replaced by salted
    tokens, and the number of replacements.

    ``keys`` is a key table (``merge_keys``) of the same salt: its few long tokens, of texts whose short one was
    taken, are used here too.
    """
    staged = docs.withColumn("_hinted", F.when(F.col(text).rlike(_HINT), F.col(text)))
    none = F.array().cast("array<string>")
    found = F.coalesce(F.regexp_extract_all("_hinted", F.lit(_FAST_PATTERN), F.lit(0)), none)
    staged = staged.withColumn("_found", found)
    longer = [] if keys is None else keys.where(F.col("is_long")).select("original", "token").limit(_MOST_LONG + 1).collect()
    if len(longer) > _MOST_LONG:
        raise ValueError(f"more than {_MOST_LONG} tokens collide; use more digits")
    taken = F.create_map(*[F.lit(x) for r in longer for x in (r["original"], r["token"])]) if longer else None

    def token(match: Column) -> Column:
        short = pii_token(match, salt)
        return short if taken is None else F.coalesce(F.try_element_at(taken, match), short)

    masked = splice(F.col("_hinted"), _FAST_PATTERN, token, F.col("_found"))
    return staged.withColumns({
        out: F.when(F.size("_found") > 0, masked).otherwise(F.col(text)),
        "n_masked": F.size("_found").cast("bigint"),
    }).drop("_hinted", "_found")


_MOST_LONG = 10_000


def pseudonym_keys(docs: DataFrame, text: str, salt: str, digits: int = TOKEN_DIGITS) -> DataFrame:
    """Key table: distinct (token, original). Distinct combines map-side."""
    found = F.explode(F.regexp_extract_all(F.col(text), F.lit(_FAST_PATTERN), F.lit(0))).alias("original")
    return docs.where(F.col(text).rlike(_HINT)).select(found).distinct().select(pii_token(F.col("original"), salt, digits).alias("token"), "original")


def merge_keys(keys: DataFrame | None, docs: DataFrame, text: str, salt: str, batch: int, digits: int = TOKEN_DIGITS) -> DataFrame:
    """The key table after a batch: (original, token, is_long, batch). Store it, and pass it to the next batch.

    A text that is known keeps its token and batch. Of new texts whose short token is taken, or that share
    one, all but the first in order get the token of the whole digest, so a token always leads back to
    one text. A batch merged twice changes nothing.
    """
    found = pseudonym_keys(docs, text, salt, digits)
    if keys is not None:
        found = found.join(keys.select("original"), "original", "left_anti")
        found = found.join(keys.where(~F.col("is_long")).select("token", F.lit(True).alias("_taken")), "token", "left")
    else:
        found = found.withColumn("_taken", F.lit(False))
    # texts that share a short token are few, as tokens are digests
    place = F.row_number().over(Window.partitionBy("token").orderBy("original"))
    is_long = F.coalesce("_taken", F.lit(False)) | (place > 1)
    new = found.withColumn("is_long", is_long).select(
        "original", F.when(F.col("is_long"), pii_token(F.col("original"), salt, 64)).otherwise(F.col("token")).alias("token"),
        "is_long", F.lit(batch).cast("bigint").alias("batch"))
    return new if keys is None else keys.select(*new.columns).unionByName(new)


def _entities(text: Column) -> Column:
    """Decode named (all that HTML 5 ends by a semicolon), decimal and hexadecimal character references in one pass."""
    known = {name[:-1]: shown for name, shown in html5.items() if name.endswith(";")}
    # names go by their first two letters, so that a look-up passes few of the two thousand
    groups: dict[str, list[Column]] = {}
    for name, shown in known.items():
        groups.setdefault(name[:2], []).extend((F.lit(name), F.lit(shown)))
    names = F.create_map(*[x for lead, pairs in groups.items() for x in (F.lit(lead), F.create_map(*pairs))])

    def decode(match: Column) -> Column:
        body = F.substring(match, 2, 64)
        body = F.regexp_replace(body, ";$", "")
        hexadecimal = F.conv(F.regexp_extract(body, r"^#[xX]([0-9A-Fa-f]+)$", 1), 16, 10)
        code = F.when(body.startswith("#x") | body.startswith("#X"), hexadecimal).when(
            body.startswith("#"), F.substring(body, 2, 64)
        ).try_cast("int")
        # A code point is written as UTF-32 text; chr() alone covers one byte.
        number = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.coalesce(F.when(body.startswith("#"), F.when(code.between(1, 1114111), number)).otherwise(F.try_element_at(F.try_element_at(names, F.substring(body, 1, 2)), body)), match)

    return F.when(text.contains("&"), splice(text, r"&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});", decode)).otherwise(text)


def _tidy(text: Column) -> Column:
    lines = F.regexp_replace(text, r"[ \t\r\f]{2,}|[\t\r\f]", " ")
    return F.btrim(F.regexp_replace(lines, r" ?\n[ \n]*", "\n"), F.lit(" \n"))


# Inside a tag: anything but its end, quoted values whole. Runs are possessive, so nothing is tried twice.
_ATTRIBUTES = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""
_RAW = "script|style|head|noscript|template|iframe|noframes"
_BLOCKS = (
    "p|div|br|hr|li|ul|ol|dl|dt|dd|h[1-6]|tr|table|article|section|header|footer|nav|main|blockquote|pre|aside|address|"
    "fieldset|figure|figcaption|form|details|summary|thead|tbody|tfoot|caption|option|menu|dialog|hgroup|search"
)


def html_to_text(pages: DataFrame, html: str) -> DataFrame:
    """Add title and visible text. Raw text elements, the head and comments go; block tags break lines.

    The scan knows the states of a page: text, tag, quoted attribute (which may hold ``>``), comment, and raw
    text up to its own end tag. A comment or raw text that is left open reaches to the end; a ``<`` that starts
    no tag is text, as is a tag without any ``>``; a quote that is never closed ends with its tag's ``>``.
    """
    source = F.col(html)
    end = rf"(?:\s{_ATTRIBUTES})?"
    # Whichever comes first, a comment or raw text, hides the other's signs: one alternation, from the left.
    hidden = rf"(?is)<!--(?:>|->|.*?(?:--!?>|$(?!\n)))|<({_RAW}){end}(?<!/)>.*?(?:</\1\s*+{end}>|$(?!\n))"
    visible = F.regexp_replace(source, hidden, " ")
    visible = F.regexp_replace(visible, r"[\r\n]", " ")
    visible = F.regexp_replace(visible, rf"(?i)</?(?:{_BLOCKS}){end}/?>", "\n")
    visible = F.regexp_replace(visible, rf"(?i)</?[a-z]{_ATTRIBUTES}>|<[!?][^>]*+>|</?[a-z][^<>]*+>", "")
    title = F.regexp_extract(source, rf"(?is)<title{end}>(.*?)</title\s*>", 1)
    # Staged, so that the steps that look at a text several times do not repeat what made it.
    staged = pages.withColumns({"_title": title, "_visible": visible})
    staged = staged.withColumns({"_title": _entities(F.col("_title")), "_visible": _entities(F.col("_visible"))})
    return staged.withColumns({"title": _tidy(F.col("_title")), "visible_text": _tidy(F.col("_visible"))}).drop("_title", "_visible")


def evidence_spans(docs: DataFrame, text: str, value: str) -> DataFrame:
    """Add span_start and span_end (0-based, end exclusive) of the value in its text, ignoring case;
    null when it does not occur. Offsets count characters of the text as it is, also where changing
    case changes lengths."""
    literal = F.replace(F.col(f"`{value}`"), F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    pattern = F.concat(F.lit("(?iu)\\Q"), literal, F.lit("\\E"))
    # The first occurrence in any case, as it is written in the text.
    hit = F.when(F.length(f"`{value}`") > 0, F.regexp_substr(F.col(f"`{text}`"), pattern))
    staged = docs.withColumn("_hit", hit)
    at = F.expr(f"locate(`_hit`, `{text}`)") - 1
    return staged.withColumns({
        "span_start": at.cast("bigint"), "span_end": (at + F.length("_hit")).cast("bigint"),
    }).drop("_hit")


def normal_label(col: Column) -> Column:
    """Label text for comparison: lower case, runs of other characters as one blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(col), r"[^\p{L}\p{N}]+", " "))


def _label_pieces(labels: DataFrame, distance: int) -> DataFrame:
    """(length, piece_no, piece, label_no): each label cut into ``distance`` + 1 pieces of nearly equal length."""
    n = F.length("norm")
    pieces = F.array(*[
        F.struct(F.lit(i).alias("piece_no"), F.substring("norm", (F.floor(n * i / (distance + 1)) + 1).cast("int"),
                 (F.floor(n * (i + 1) / (distance + 1)) - F.floor(n * i / (distance + 1))).cast("int")).alias("piece"))
        for i in range(distance + 1)])
    return labels.select("norm", "label_no", n.alias("length"), F.inline(pieces)).select("length", "piece_no", "piece", "label_no")


def _value_probes(values: DataFrame, distance: int) -> DataFrame:
    """(length, piece_no, piece, norm): the pieces that a value can share with a label of each near length.

    A label within the distance has a piece that no edit touches; it stands in the value as it is, moved by
    the distance at most.
    """
    n = F.length("norm")
    lengths = F.sequence(F.greatest(n - distance, F.lit(0)), n + distance)
    staged = values.select("norm", F.explode(lengths).alias("length")).select("norm", "length", F.explode(F.sequence(F.lit(0), F.lit(distance))).alias("piece_no"))
    start = F.floor(F.col("length") * F.col("piece_no") / (distance + 1)).cast("int")
    size = F.floor(F.col("length") * (F.col("piece_no") + 1) / (distance + 1)).cast("int") - start
    first, last = F.greatest(start - distance, F.lit(0)), F.least(start + distance, n - size)
    placed = staged.select("norm", "length", "piece_no", size.alias("size"), F.explode(F.when(first <= last, F.sequence(first, last))).alias("at"))
    return placed.select(
        "length", "piece_no", F.substring("norm", F.col("at") + 1, F.col("size")).alias("piece"), "norm").distinct()


def unify_labels(df: DataFrame, col: str, labels: list[str] | DataFrame, max_distance: int = 2) -> DataFrame:
    """Add label, match (exact, near, none) and distance.

    ``labels`` is a list or a table (label_no, label), of any size. Equal normalised text wins; else the label at
    the least edit distance up to ``max_distance``, earlier labels first. Each different value is looked
    up once: equal texts by a join, the others by an index of label pieces, whose candidates alone are
    measured. The work of a value does not depend on the number of labels but on those that share a
    piece with it. A null value has no label.
    """
    spark = df.sparkSession
    if not isinstance(labels, DataFrame):
        labels = spark.createDataFrame(pa.table({"label_no": pa.array(range(len(labels)), pa.int64()), "label": pa.array(labels, pa.string())}))
    named = labels.select("label_no", "label", normal_label(F.col("label")).alias("norm")).where("norm is not null")
    first = cut_lineage(named.groupBy("norm").agg(F.min(F.struct("label_no", "label")).alias("first")).select("norm", "first.label_no", "first.label"), "labels")
    values = df.select(normal_label(F.col(col)).alias("norm")).where("norm is not null").distinct()
    known = cut_lineage(values.join(checked_broadcast(first), "norm", "left"), "values")
    found = known.where("label_no is not null").select("norm", "label", F.lit(0).alias("distance"))
    if max_distance > 0:
        probes = _value_probes(known.where("label_no is null").select("norm"), max_distance)
        pieces = checked_broadcast(_label_pieces(first, max_distance))
        candidates = probes.join(pieces, ["length", "piece_no", "piece"]).select("norm", "label_no").distinct()
        texts = first.select("label_no", "label", F.col("norm").alias("label_norm"))
        measured = candidates.join(checked_broadcast(texts), "label_no").withColumn("distance", F.levenshtein("norm", "label_norm", max_distance))
        best = measured.where("distance >= 0").groupBy("norm").agg(F.min(F.struct("distance", "label_no", "label")).alias("best"))
        found = found.unionByName(best.select("norm", "best.label", "best.distance"))
    answers = cut_lineage(found.select("norm", F.col("label").alias("_label"), F.col("distance").cast("bigint").alias("_distance")), "label-of-value")
    staged = df.withColumn("_norm", normal_label(F.col(col)))
    joined = staged.join(checked_broadcast(answers), staged["_norm"] == answers["norm"], "left")
    return joined.select(
        *[staged[c] for c in df.columns], F.col("_label").alias("label"),
        F.when(F.col("_distance") == 0, "exact").when(F.col("_distance") > 0, "near").otherwise("none").alias("match"),
        F.col("_distance").alias("distance"),
    )


def extend_enum(registry: DataFrame, batch: DataFrame, value: str, order: str) -> DataFrame:
    """Values of a batch that the registry lacks, with count and first-seen place."""
    seen = batch.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"), F.min(order).alias("first_seen"))
    return seen.join(registry.select(value).distinct(), value, "left_anti")
