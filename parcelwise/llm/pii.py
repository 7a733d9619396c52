"""Personal data: spans of fixed forms, and terms that disclose them by what the corpus shows of both together.

DataFrame functions only. A term's disclosure of a protected value e is the share of e's information that it gives
away: PMI(term, e) / IC(e) with PMI = log2(N c(term, e) / (c(term) c(e))) and IC = log2(N / c(e)), where N and c(.)
count lines of the corpus and c(term, e) counts those of e with the term at most ``REACH`` characters away, in the line
or in the two before and after it. Terms of at least ``min_support`` such lines, copies of a line among the same lines
not counted, and a disclosure of at least ``generalise_at`` are generalised, wherever they stand, to the kind of what they
disclose; from ``remove_at`` on they are removed. A disclosure over few lines lets a term stand in many others by chance, so a term of fewer than
``firm_support`` lines must also have ``least_given`` of all its lines at e. One line alone discloses nothing: each rare
word beside a value would count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_side, written

#: The forms, as the contract names them, written so that no match needs a retry; \G lets a match start where the last one ended.
FORMS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for any match of a form to pass its check; cheaper to look for than the form.
HINTS = {
    "email": "contains({}, '@')",
    "ip": r"{} RLIKE r'[0-9]\.[0-9]++\.[0-9]++\.[0-9]'",
    "card": r"{} RLIKE r'(?:[0-9][\x20-]?){{13}}[0-9]'",
    "phone": r"contains({}, '+') AND {} RLIKE r'\+[0-9]'",
}
KINDS = ("email", "ip", "card", "phone", "term")
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}
#: A term: a run of three letters or more that isn't part of a longer name, number or address.
BEFORE, AFTER = r"(?<![\p{L}\p{N}@._%+-])", r"(?![\p{L}\p{N}@_%+-]|\.[\p{L}\p{N}])"
TERM = BEFORE + r"\p{L}{3,}" + AFTER
REACH = 64
SPAN = "array<struct<start:int,end:int,value:string>>"


def let(value: str, name: str, body: str) -> str:
    """SQL of ``body`` with ``name`` for a value that is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def in_blocks(items: str, body: str) -> str:
    """SQL of ``body`` with ``blocks`` for an array that isn't empty, cut into about as many runs as each has items.

    Folds that append to what they have are quadratic; over blocks, and then over what the blocks give, they aren't.
    """
    cut = let("CAST(ceil(sqrt(size(every))) AS INT)", "width", "transform(sequence(0, (size(every) - 1) DIV width), i -> slice(every, i * width + 1, width))")
    return let(items, "every", let(cut, "blocks", body))


def found(text: str, pattern: str, hint: str) -> Column:
    """All matches of a pattern (SQL text of the column and of the pattern) as (start, end, value), in code points, end exclusive; none unless ``hint`` holds.

    What stands between matches and the matches themselves, laid end to end, give the positions.
    """
    none = f"CAST(array() AS {SPAN})"
    matches = f"""filter(zip_with(split({text}, {pattern}, -1), regexp_extract_all({text}, {pattern}, 0), (gap, m) -> named_struct('gap', char_length(gap), 'n', char_length(m), 'value', m)), x -> x.value IS NOT NULL)"""
    starts = "aggregate(blocks, array(0), (a, block) -> concat(a, array(element_at(a, -1) + aggregate(block, 0, (total, x) -> total + x.gap + x.n))))"
    inside = f"""aggregate(block, struct(first AS at, {none} AS spans),
        (a, x) -> struct(a.at + x.gap + x.n AS at, concat(a.spans, array(named_struct('start', a.at + x.gap, 'end', a.at + x.gap + x.n, 'value', x.value))) AS spans), a -> a.spans)"""
    placed = in_blocks("matches", let(starts, "starts", f"flatten(zip_with(blocks, slice(starts, 1, size(blocks)), (block, first) -> {inside}))"))
    return F.expr(f"CASE WHEN {hint} THEN {let(matches, 'matches', f'CASE WHEN size(matches) = 0 THEN {none} ELSE {placed} END')} ELSE {none} END")


def quoted(pattern: str) -> str:
    return "r'" + pattern + "'"


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    backwards = F.reverse(F.split(number, ""))
    total = F.aggregate(
        F.transform(backwards, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((2 * d.cast("int")) % 10 + F.floor(d.cast("int") / 5).cast("int"))),
        F.lit(0),
        lambda a, d: a + d,
    )
    return total % 10 == 0


def small(part: Column) -> Column:
    """Whether a string of digits is at most 255."""
    bare = F.regexp_replace(part, "^0+(?=[0-9])", "")
    return (F.length(bare) <= 3) & F.coalesce(bare.try_cast("int") <= 255, F.lit(False))


def base_spans(text: str) -> dict[str, Column]:
    """For each kind the spans of its form in a column (named in SQL) that pass its check."""
    spans = {kind: found(text, quoted(form), HINTS[kind].format(*[text] * 2)) for kind, form in FORMS.items()}
    return {
        "email": spans["email"],
        "ip": F.filter(spans["ip"], lambda s: F.forall(F.split(s["value"], r"\."), small)),
        "card": F.filter(spans["card"], lambda s: F.length(digits(s["value"])).between(14, 19) & luhn(digits(s["value"]))),
        "phone": F.filter(spans["phone"], lambda s: F.length(digits(s["value"])).between(10, 15)),
    }


def lines_of(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode(F.split("text", "\n", -1)).alias("line"))


def placed_lines(rows: DataFrame) -> DataFrame:
    """(before, line, after): each line with the ends of the two lines before and after it that lie within ``REACH``."""
    end = lambda i: f"right(get(lines, i - {i}), {REACH + 1})"
    begin = lambda i: f"left(get(lines, i + {i}), {REACH + 1})"
    placed = f"transform(lines, (x, i) -> named_struct('before', concat_ws('\n', {end(2)}, {end(1)}), 'line', x, 'after', concat_ws('\n', {begin(1)}, {begin(2)})))"
    return rows.select(F.split("text", "\n", -1).alias("lines")).select(F.inline(F.expr(placed)))


def disclosing(rows: DataFrame, min_support: int, generalise_at: float, remove_at: float, broadcast_bytes: int, firm_support: int, least_given: float) -> DataFrame:
    """(term, removed, kind) for all terms over the thresholds; kind: that of the value it discloses most."""
    hints = " OR ".join(f"({h})" for h in HINTS.values())
    near = rows.where(F.expr(hints.format(*["text"] * 5)))
    near = placed_lines(near).where(F.expr(hints.format(*["line"] * 5))).groupBy("before", "line", "after").agg(F.count("*").alias("copies"))
    spans = base_spans("line")
    kinds = [F.transform(spans[k], of_kind(k)) for k in FORMS]
    near = near.select("before", "line", "after", "copies", F.explode(F.concat(*kinds)).alias("s"))
    left = F.expr(f"right(concat(before, '\n', substring(line, greatest(s.start - {REACH + 1}, 0) + 1, least(s.start, {REACH + 1}))), {REACH + 1})")
    right = F.expr(f"left(concat(substring(line, s.end + 1, {REACH + 1}), '\n', after), {REACH + 1})")
    # a word that the window cuts is left out
    left = F.when(F.length(left) > REACH, F.regexp_replace(left, r"^\S+", "")).otherwise(left)
    right = F.when(F.length(right) > REACH, F.regexp_replace(right, r"\S+$", "")).otherwise(right)
    near = near.select(F.xxhash64("before", "line", "after").alias("place"), "copies", F.col("s.kind").alias("kind"), F.lower("s.value").alias("value"), F.lower(F.concat_ws("\n", left, right)).alias("around"))
    near = near.groupBy("kind", "value", "place").agg(F.max("copies").alias("copies"), F.flatten(F.collect_set(F.expr(f"regexp_extract_all(around, {quoted(TERM)}, 0)"))).alias("terms"))
    near = written(near.select("kind", "value", "copies", F.array_distinct("terms").alias("terms")), "contexts")
    values = near.groupBy("kind", "value").agg(F.sum("copies").alias("c_value"))
    pairs = near.select("kind", "value", "copies", F.explode("terms").alias("term")).groupBy("term", "kind", "value").agg(F.sum("copies").alias("c_both"), F.count("*").alias("support"))
    pairs = written(pairs.where(F.col("support") >= min_support).join(values, ["kind", "value"]), "pairs")
    lines = lines_of(rows)
    said = lines.select(F.explode(F.array_distinct(F.expr(f"regexp_extract_all(lower(line), {quoted(TERM)}, 0)"))).alias("term"))
    # only terms that stand beside values are counted, where they are read
    asked = small_side(pairs.select("term").distinct(), broadcast_bytes)
    seen = said.join(asked, "term").groupBy("term").agg(F.count("*").alias("c_term"))
    total = lines.count()
    # lines of e may share a neighbour that has the term
    both = F.least("c_both", "c_term")
    share = F.log2(F.lit(float(total)) * both / (F.col("c_term") * F.col("c_value"))) / F.log2(F.lit(float(total)) / F.col("c_value"))
    over = seen.join(pairs, "term").where(F.col("c_value") < total).withColumn("share", share).where(F.col("share") >= generalise_at)
    over = over.where((F.col("support") >= firm_support) | (both >= least_given * F.col("c_term")))
    return over.groupBy("term").agg((F.max("share") >= remove_at).alias("removed"), F.max_by("kind", F.struct("share", "kind")).alias("kind"))


def of_kind(kind: str):
    return lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), F.lit(kind).alias("kind"))


def detect(
    documents: DataFrame, key: str = "doc_id", text: str = "text", min_support: int = 2, generalise_at: float = 0.8, remove_at: float = 0.95, broadcast_bytes: int = 32 << 20, firm_support: int = 5, least_given: float = 0.5
) -> DataFrame:
    """All columns of ``documents`` as the struct ``row``, ``text``, and for each kind an array of (start, end, value), for terms with ``removed`` and ``kind`` too.

    Null texts count as empty and have no spans. Rows are kept one for one; equal key and text share their terms.
    Further columns stay in ``row``, whatever their names; an empty table gives an empty one.
    """
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"))
    whole = F.coalesce(F.col(f"row.`{text}`").cast("string"), F.lit(""))
    keyed = rows.select(F.col(f"row.`{key}`").alias("key"), F.xxhash64(whole).alias("tie"), whole.alias("text"))
    terms = written(disclosing(keyed.select("text"), min_support, generalise_at, remove_at, broadcast_bytes, firm_support, least_given), "terms")
    where = keyed.select("key", "tie", F.explode(F.array_distinct(F.expr(f"regexp_extract_all(lower(text), {quoted(TERM)}, 0)"))).alias("term"))
    where = where.join(small_side(terms, broadcast_bytes), "term").groupBy("key", "tie").agg(F.collect_set(F.struct("term", "removed", "kind")).alias("said"))
    where = small_side(written(where.withColumnsRenamed({"key": "said_key", "tie": "said_tie"}), "said"), broadcast_bytes)
    joined = rows.join(where, F.col(f"row.`{key}`").eqNullSafe(F.col("said_key")) & (F.xxhash64(whole) == F.col("said_tie")), "left").select("row", whole.alias("text"), "said")
    positions = F.filter(found("text", quoted("(?iu)" + TERM), "size(said) > 0"), lambda s: F.exists("said", lambda t: t["term"] == F.lower(s["value"])))
    marked = F.transform(positions, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), F.filter("said", lambda t: t["term"] == F.lower(s["value"]))[0].alias("of")))
    marked = F.transform(marked, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), s["of"]["removed"].alias("removed"), s["of"]["kind"].alias("kind")))
    none = F.array().cast("array<struct<start:int,end:int,value:string,removed:boolean,kind:string>>")
    return joined.select("row", "text", *[c.alias(k) for k, c in base_spans("text").items()], F.when(F.col("said").isNull(), none).otherwise(marked).alias("term"))


def named(kind: str, label: str | None = None):
    """A function from a span to (start, rank of the kind, end, label)."""
    return lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), s["end"].alias("end"), F.lit(label or kind).alias("label"))


def listed(kinds) -> Column:
    """kind:start:end of all spans of these kinds by start, then kind as listed, comma-joined."""
    every = F.concat(*[F.transform(F.col(k), named(k)) for k in kinds])
    return F.array_join(F.transform(F.array_sort(every), lambda s: F.concat_ws(":", s["label"], s["start"], s["end"])), ",")


def summary(detected: DataFrame, key: str = "doc_id") -> DataFrame:
    """(``key``, n_email, n_ip, n_card, n_phone, base_sha256, spans) of the rows of ``detect``."""
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in FORMS]
    return detected.select(F.col(f"row.{key}").alias(key), *counts, F.sha2(listed(FORMS), 256).alias("base_sha256"), listed(KINDS).alias("spans"))


def sanitised(detected: DataFrame, text: str = "text") -> DataFrame:
    """The rows that ``detect`` was given, with each span replaced in ``text``.

    A value is replaced by its kind's label; a term is generalised to the kind of what it discloses, or removed. Spans
    that overlap are replaced together, by the label of the first. Null texts stay null.
    """
    every = F.array_sort(
        F.concat(
            *[F.transform(F.col(k), named(k, LABELS[k])) for k in FORMS],
            F.transform("term", lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index("term")).alias("rank"), s["end"].alias("end"), F.when(s["removed"], "").otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit(" RELATED]"))).alias("label"))),
        )
    )
    # where each block of spans begins: the end of all before it
    heads = "aggregate(blocks, array(0), (a, block) -> concat(a, array(greatest(element_at(a, -1), array_max(transform(block, x -> x.end))))))"
    inside = """aggregate(block, struct(head AS at, '' AS out),
        (a, s) -> CASE WHEN s.start >= a.at THEN struct(s.end AS at, concat(a.out, substring(part, a.at - head + 1, s.start - a.at), s.label) AS out) ELSE struct(greatest(a.at, s.end) AS at, a.out AS out) END, a -> a.out)"""
    part = let("substring(text, head + 1, array_max(transform(block, x -> x.end)) - head)", "part", inside)
    parts = f"concat(array_join(zip_with(blocks, slice(heads, 1, size(blocks)), (block, head) -> {part}), ''), substring(text, element_at(heads, -1) + 1))"
    clean = F.expr(f"CASE WHEN size(spans) = 0 THEN text ELSE {in_blocks('spans', let(heads, 'heads', parts))} END")
    replaced = detected.select("row", "text", every.alias("spans")).select("row", clean.alias("clean"))
    fields = detected.schema["row"].dataType.names
    return replaced.select(*[F.when(F.col(f"row.`{c}`").isNotNull(), F.col("clean")).alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in fields])
