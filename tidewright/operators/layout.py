"""Rows of a page from tokens, and the numbers in them as candidates for fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.rates import clamp
from tidewright.functions.text import PAYSLIP_LABELS, financial, first_label, fragments, period_score, search_text
from tidewright.session import merged

#: How near a row's middle a token has to be, and which rows belong to a label's surroundings.
ROW_REACH, ROW_SHARE, NEAR_Y, NEAR_ROWS, NEAR_MOST = 7.0, 0.65, 72.0, 2, 5

_TOKEN = "struct<page:int,y:double,x:double,ord:int,text:string,width:double,height:double,confidence:double>"
_ROW = f"struct<page:int,y:double,total:double,tokens:array<{_TOKEN}>>"


def build_rows(tokens: DataFrame) -> DataFrame:
    """doc_id, row, page, y, tokens (by x), direct_text, reverse_text, search_text.

    In order of page, y, x and ord, a token joins the first row of its page whose y is near enough, and moves that row's y to the mean; else it begins a
    row. A row's place depends on all tokens before, so this is a fold over each document's tokens.
    """
    each = F.struct("page", "y", "x", "ord", "text", "width", "height", "confidence").cast(_TOKEN)
    docs = tokens.groupBy("doc_id").agg(F.array_sort(F.collect_list(each)).alias("all"))

    def join(rows: Column, t: Column) -> Column:
        near = F.transform(rows, lambda r: (r["page"] == t["page"]) & (F.abs(r["y"] - t["y"]) <= F.greatest(F.lit(ROW_REACH), t["height"] * ROW_SHARE)))
        at = F.array_position(near, True)

        def grown(r: Column, i: Column) -> Column:
            total, all_ = r["total"] + t["y"], F.concat(r["tokens"], F.array(t))
            return F.when(i + 1 == at, F.struct(r["page"].alias("page"), (total / F.size(all_)).alias("y"), total.alias("total"), all_.alias("tokens"))).otherwise(r)

        new = F.struct(t["page"].alias("page"), t["y"].alias("y"), t["y"].alias("total"), F.array(t).alias("tokens"))
        return F.when(at > 0, F.transform(rows, grown)).otherwise(F.concat(rows, F.array(new))).cast(f"array<{_ROW}>")

    rows = docs.select("doc_id", F.posexplode(F.aggregate("all", F.array().cast(f"array<{_ROW}>"), join)).alias("row", "r"))
    by_x = F.array_sort(F.transform("r.tokens", lambda t, i: F.struct(t["x"], i.alias("i"), t["y"], t["text"], t["width"], t["confidence"])))
    rows = rows.select("doc_id", "row", "r.page", "r.y", by_x.alias("tokens"))
    texts = F.transform("tokens", lambda t: t["text"])
    rows = rows.withColumns({"direct_text": F.array_join(texts, " "), "reverse_text": F.array_join(F.reverse(texts), " ")})
    return rows.withColumn("search_text", search_text(F.concat_ws(" ", "direct_text", "reverse_text")))


def row_confidence(tokens: Column) -> Column:
    """The mean confidence of a row's tokens; 0.8 without tokens."""
    return F.when(F.size(tokens) > 0, F.aggregate(tokens, F.lit(0.0), lambda a, t: a + t["confidence"]) / F.size(tokens)).otherwise(F.lit(0.8))


def distance_score(tokens: Column, raw: Column) -> Column:
    """How near a number is to the next token without numbers in its row, from 0.55 to 0.92; 0.68 if no token has the number, 0.72 without others."""
    own = F.get(F.filter(tokens, lambda t: F.contains(t["text"], raw) | F.contains(raw, t["text"])), 0)
    labels = F.filter(tokens, lambda t: F.size(fragments(t["text"])) == 0)
    middle = lambda t: t["x"] + t["width"] / 2
    gap = F.array_min(F.transform(labels, lambda t: F.abs(middle(t) - middle(own))))
    return F.when(own.isNull(), F.lit(0.68)).when(F.size(labels) == 0, F.lit(0.72)).otherwise(F.greatest(F.lit(0.55), 0.92 - gap / 900))


def row_candidates(rows: DataFrame) -> DataFrame:
    """A row for each number in each row: id, ord, raw, amount, rate, explicit (has a percent sign), x, y, confidence, and the row's columns.

    Numbers are looked for in each token; only where none has any, in the row's text, with the row's place and confidence.
    """
    base = rows.select("doc_id", "row", "page", F.col("y").alias("row_y"), "tokens", "direct_text", "search_text", F.format_string("p%d-r%d", "page", "row").alias("row_id"))
    place = lambda t, f, n, i, x, y, c: F.struct(t.alias("t"), n.alias("n"), f.alias("raw"), x.alias("x"), y.alias("y"), c.alias("confidence"), i.alias("id"))

    def of_token(t: Column, i: Column) -> Column:
        return F.transform(fragments(t["text"]), lambda f, n: place(i, f, n, F.concat(F.col("row_id"), F.lit("-t"), i, F.lit("-n"), n), t["x"], t["y"], t["confidence"]))

    in_tokens = F.flatten(F.transform("tokens", of_token))
    in_row = F.transform(fragments(F.col("direct_text")), lambda f, n: place(F.lit(0), f, n, F.concat(F.col("row_id"), F.lit("-n"), n), F.lit(0.0), F.col("row_y"), row_confidence(F.col("tokens"))))
    found = base.withColumn("in_tokens", in_tokens).withColumn("found", F.when(F.size("in_tokens") > 0, F.col("in_tokens")).otherwise(in_row))
    out = found.select("doc_id", "row", "page", "row_y", "tokens", "search_text", "row_id", F.posexplode("found").alias("ord", "c"))
    raw = F.col("c.raw")
    return out.select("doc_id", "row", "page", "row_y", "tokens", "search_text", "row_id", "ord", "c.id", raw.alias("raw"), financial(raw, "amount").alias("amount"), financial(raw, "rate").alias("rate"), F.contains(raw, F.lit("%")).alias("explicit"), "c.x", "c.y", "c.confidence")


def scored(candidates: DataFrame) -> DataFrame:
    """candidates as amounts and as rates (kind, value, score) where they can be such: amounts are 20 or more and have no percent sign, rates do or are 0.3 at most."""
    kinds = F.explode(F.array(F.struct(F.lit("amount").alias("kind"), F.col("amount").alias("as")), F.struct(F.lit("rate").alias("kind"), F.col("rate").alias("as"))))
    out = candidates.withColumn("k", kinds).withColumns({"kind": F.col("k.kind"), "value": F.col("k.as.value"), "format": F.col("k.as.confidence")})
    out = out.filter("value is not null").filter(F.when(F.col("kind") == "amount", ~F.col("explicit") & (F.col("value") >= 20)).otherwise(F.col("explicit") | (F.col("value") <= 0.30)))
    parts = row_confidence(F.col("tokens")) * 0.35 + F.col("confidence") * 0.25 + distance_score(F.col("tokens"), F.col("raw")) * 0.25 + F.col("format") * 0.15
    return out.withColumn("score", clamp(parts, 0, 1)).drop("k", "format", "amount", "rate", "tokens")


def anchors(rows: DataFrame) -> DataFrame:
    """field, alias_id and the row, for each row that holds one of a field's labels (the first of its labels in their order)."""
    labels = F.array(*[F.struct(F.lit(field).alias("field"), first_label(F.col("search_text"), field).alias("alias_id")) for field in PAYSLIP_LABELS])
    out = rows.withColumn("label", F.explode(F.filter(labels, lambda x: x["alias_id"].isNotNull())))
    return out.select("doc_id", "label.field", "label.alias_id", F.col("row").alias("anchor"), F.col("page").alias("anchor_page"), F.col("y").alias("anchor_y"), F.col("search_text").alias("anchor_text"))


def neighborhood(anchored: DataFrame, rows: DataFrame, most: int = NEAR_MOST, ties: tuple[str, ...] = ("apart", "row")) -> DataFrame:
    """For each anchor the nearest rows of its page, itself included: within NEAR_Y or NEAR_ROWS, by distance, then by `ties` (rows apart, then place)."""
    other = rows.select("doc_id", "row", F.col("page").alias("anchor_page"), F.col("y").alias("row_y"))
    away, apart = F.abs(F.col("row_y") - F.col("anchor_y")), F.abs(F.col("row") - F.col("anchor"))
    near = anchored.join(merged(other), ["doc_id", "anchor_page"]).withColumns({"away": away, "apart": apart}).filter((F.col("away") <= NEAR_Y) | (F.col("apart") <= NEAR_ROWS))
    rank = F.row_number().over(Window.partitionBy("doc_id", "field", "anchor").orderBy("away", *ties))
    return near.withColumn("near", rank).filter(F.col("near") <= most).drop("row_y")


def label_values(rows: DataFrame) -> DataFrame:
    """For each label's row, the amounts and rates around it by confidence (rank from 1), and the order of the field's labels (match from 1).

    Confidence falls with the distance from the label; period is what words on periods in both rows add.
    """
    near = neighborhood(anchors(rows), rows)
    out = near.join(merged(scored(row_candidates(rows))), ["doc_id", "row"]).withColumns(
        {"value_confidence": F.greatest(F.lit(0.0), F.col("score") - F.col("away") / 260), "period": period_score(F.concat_ws(" ", "anchor_text", "search_text"))}
    )
    each = Window.partitionBy("doc_id", "field", "anchor", "kind")
    out = out.withColumn("rank", F.row_number().over(each.orderBy(F.col("value_confidence").desc(), "near", "ord")))
    best = F.max("value_confidence").over(Window.partitionBy("doc_id", "field", "anchor"))
    out = out.withColumn("best", best)
    order = Window.partitionBy("doc_id", "field").orderBy(F.col("best").desc(), "anchor")
    return out.withColumn("match", F.dense_rank().over(order))


