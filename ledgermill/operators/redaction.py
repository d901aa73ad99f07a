"""Where personal data stands on a page: words to lines and rows, labels and their values.

Words are ``array<struct<x0,y0,x1,y1 double, text string, block int, line int>>`` by doc and page.
Spans found here are what a document writer would black out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pii import clear, pii_spans
from ..functions.text import fold, let

# Labels of personal data and labels that end a value.
LABELS = {
    "name": ["kart sahibi", "kart hamili", "hesap sahibi", "musteri adi", "adi soyadi", "ad soyad", "sayin"],
    "stop": ["donem borcu", "asgari odeme", "son odeme", "hesap kesim", "ekstre tarihi", "kart no", "kart numarasi", "kart limiti", "toplam borc"],
    "address": ["adres"],
    "tc": ["t.c. kimlik no", "tc kimlik no", "t.c. kimlik", "tc kimlik", "tckn"],
    "customer_no": ["musteri numarasi", "musteri no"],
    "phone": ["telefon", "cep tel", "gsm"],
    "email": ["e-posta", "eposta", "e-mail", "email"],
}
ROW_GAP, ADDRESS_LINES, SCAN, ALIGNED, LINE_GAP = 3.0, 4, 14, 4.0, 2.2
ROWS = "array<struct<c:double,words:array<struct<x0:double,y0:double,text:string>>>>"


def lines_of(words: DataFrame) -> DataFrame:
    """doc, page, block, line, text, x0, y0, height: words of a line by falling into its block and line."""
    each = words.select("doc", "page", F.explode("words").alias("w")).select("doc", "page", "w.*")
    order = F.array_sort(F.collect_list(F.struct("x0", "y0", "x1", "y1", "text")))
    rows = each.groupBy("doc", "page", "block", "line").agg(order.alias("words"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), (F.max("y1") - F.min("y0")).alias("height"))
    return rows.withColumn("text", F.array_join(F.transform("words", lambda w: w["text"]), " "))


def visual_rows(words: DataFrame, tolerance: float = ROW_GAP) -> DataFrame:
    """doc, page, row, y0, text: a word joins the row whose first word's centre is near enough."""
    ordered = F.array_sort(F.transform("words", lambda w: F.struct(((w["y0"] + w["y1"]) / 2).alias("c"), w["x0"].alias("x0"), w["y0"].alias("y0"), w["text"].alias("text"))))

    def step(acc: Column, w: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        one = F.array(F.struct(w["x0"].alias("x0"), w["y0"].alias("y0"), w["text"].alias("text")))
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["c"].alias("c"), F.concat(last["words"], one).alias("words"))))
        return F.when((F.size(acc) > 0) & (F.abs(w["c"] - last["c"]) <= tolerance), joined).otherwise(F.concat(acc, F.array(F.struct(w["c"].alias("c"), one.alias("words")))))

    rows = words.select("doc", "page", F.posexplode(F.aggregate(ordered, F.array().cast(ROWS), step)).alias("row", "r"))
    return rows.select("doc", "page", "row", F.array_min(F.transform("r.words", lambda w: w["y0"])).alias("y0"), F.array_join(F.transform(F.array_sort("r.words"), lambda w: w["text"]), " ").alias("text"))


def _label_pattern() -> str:
    """Any label as a whole word with its colon; of labels that start together the longest."""
    labels = sorted((x for some in LABELS.values() for x in some), key=len, reverse=True)
    return r"(?U)(?<![^\W\d_])(?:" + "|".join(rf"\Q{x}\E" for x in labels) + r")(?![^\W\d_])\s*:?"


def label_hits(lines: DataFrame) -> DataFrame:
    """Adds ``hits``: (s, e, kind) of every label in a line, the longest of equal starts, none overlapping.

    Lines flagged ``is_tx``, where there is such a column, hold merchants and no labels. Null text has none.
    """
    low, pattern = F.coalesce(fold(F.col("text"), nfc=False), F.lit("")), _label_pattern()
    kinds = F.create_map(*[F.lit(x) for kind, labels in LABELS.items() for label in labels for x in (label, kind)])
    chars = lambda parts, n: F.length(F.array_join(F.slice(parts, 1, n), ""))

    def cut(t: Column) -> Column:
        # Labels become a character that no text has then, since splitting at one character compiles no pattern for each row.
        gaps = F.split(F.regexp_replace(F.translate(t, "\x00", "\x01"), pattern, "\x00"), "\x00")
        return F.struct(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)).alias("found"), gaps.alias("gaps"))

    def hit(x: Column, k: Column, c: Column) -> Column:
        start = chars(c["gaps"], k + 1) + chars(c["found"], k)
        return F.struct(start.alias("s"), (start + F.length(x)).alias("e"), F.element_at(kinds, F.regexp_replace(x, r"(?U)\s*:?$", "")).alias("kind"))

    # Each text is folded and cut once, however many labels it has.
    hits = let(let(low, cut), lambda c: F.transform(c["found"], lambda x, k: hit(x, k, c)))
    if "is_tx" in lines.columns:
        hits = F.when(F.coalesce("is_tx", F.lit(False)), F.array().cast("array<struct<s:int,e:int,kind:string>>")).otherwise(hits)
    return lines.withColumn("hits", hits)


def label_values(lines: DataFrame) -> DataFrame:
    """doc, page, block, line, kind, value: what follows each label of personal data up to the next label."""
    # The outer form, for which Spark infers no filter: that would find all hits once more, before the rows are dealt out.
    rows = label_hits(lines).select("doc", "page", "block", "line", "text", "hits", F.posexplode_outer("hits").alias("k", "h"))
    end = F.coalesce(F.get("hits", F.col("k") + 1)["s"], F.length("text"))
    value = F.trim(F.regexp_replace(F.substr("text", F.col("h.e") + 1, end - F.col("h.e")), r"^[ :,]+|[ :,]+$", ""))
    return rows.select("doc", "page", "block", "line", F.col("h.kind").alias("kind"), value.alias("value")).filter("kind <> 'stop' and value <> ''")


def known_names(values: DataFrame) -> DataFrame:
    """doc, names: labelled names of two words or more, to look for in all of the document."""
    return values.filter("kind = 'name'").filter(F.size(F.split("value", r"\s+")) >= 2).groupBy("doc").agg(F.collect_set("value").alias("names"))


def address_lines(lines: DataFrame) -> DataFrame:
    """doc, page, y0, text of unlabelled lines aligned under a name or address, at most four.

    Aligned is what starts where the label's line or the value itself does; other lines are
    passed over. A labelled line, a transaction (``is_tx``, where there is such a column), or a
    gap of over 2.2 line heights ends the address. Only the 14 following lines are looked at.
    """
    order = Window.partitionBy("doc", "page").orderBy(F.round("y0", 1), "x0")
    rows = label_hits(lines).withColumn("n", F.row_number().over(order))
    tx = F.coalesce("is_tx", F.lit(False)) if "is_tx" in lines.columns else F.lit(False)
    item = F.struct("n", "y0", "x0", "height", "text", ((F.size("hits") > 0) | tx).alias("ends"))
    ahead = F.collect_list(item).over(order.rowsBetween(1, SCAN))
    each = rows.withColumn("ahead", ahead).select("*", F.posexplode("hits").alias("k", "h")).filter(F.col("h.kind").isin("name", "address"))
    until = F.coalesce(F.get("hits", F.col("k") + 1)["s"], F.length("text"))
    starts = F.transform("words", lambda w, i: F.struct((F.length(F.array_join(F.transform(F.slice("words", 1, i), lambda x: x["text"]), " ")) + F.when(i > 0, 1).otherwise(0)).alias("at"), w["x0"].alias("x0")))
    value = F.get(F.filter(starts, lambda w: (w["at"] >= F.col("h.e")) & (w["at"] < until)), F.lit(0))
    anchors = each.withColumn("value_x", value["x0"]).filter("value_x is not null")
    state = "struct<y:double,h:double,open:boolean,out:array<struct<y0:double,text:string>>>"
    begin = F.struct(F.col("y0").cast("double").alias("y"), F.col("height").cast("double").alias("h"), F.lit(True).alias("open"), F.array().cast("array<struct<y0:double,text:string>>").alias("out")).cast(state)

    def step(acc: Column, w: Column) -> Column:
        stop = ~acc["open"] | (w["y0"] - acc["y"] > LINE_GAP * F.greatest(acc["h"], F.lit(1.0))) | (F.size(acc["out"]) >= ADDRESS_LINES)
        aside = ((F.abs(w["x0"] - F.col("x0")) >= ALIGNED) & (F.abs(w["x0"] - F.col("value_x")) >= ALIGNED)) | (w["y0"] <= acc["y"])
        closed = F.struct(acc["y"].alias("y"), acc["h"].alias("h"), F.lit(False).alias("open"), acc["out"].alias("out"))
        taken = F.struct(w["y0"].alias("y"), w["height"].alias("h"), F.lit(True).alias("open"), F.concat(acc["out"], F.array(F.struct(w["y0"].alias("y0"), w["text"].alias("text")))).alias("out"))
        return F.when(stop, closed).when(aside, acc).when(w["ends"], closed).otherwise(taken).cast(state)

    return anchors.select("doc", "page", F.explode(F.aggregate("ahead", begin, step)["out"]).alias("a")).select("doc", "page", "a.*").distinct()


def header_zone(rows: DataFrame, heights: DataFrame) -> DataFrame:
    """doc, y: the first page's bottom of the zone to black out, above the first transaction row or a quarter.

    ``rows`` are visual rows of the first page with is_tx; ``heights`` has doc, top, height.
    """
    first = rows.filter("page = 0").groupBy("doc").agg(F.min(F.when(F.col("is_tx"), F.col("y0"))).alias("first"))
    return heights.join(first, "doc", "left").select("doc", F.coalesce(F.col("first") - 2, F.col("top") + 0.25 * F.col("height")).alias("y"))


def redaction_counts(texts: DataFrame) -> DataFrame:
    """doc, counts by kind of personal data in its texts."""
    hits = texts.select("doc", F.explode(pii_spans(clear(F.col("text")))).alias("h")).groupBy("doc", F.col("h.kind").alias("kind")).agg(F.count(F.lit(1)).cast("int").alias("n"))
    return hits.groupBy("doc").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("counts"), F.sum("n").alias("total"))
