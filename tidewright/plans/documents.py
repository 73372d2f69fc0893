"""Queries over documents that are rendered from the customer table, and their SQL, which computes from the numbers what a parser has to find."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions import rates, text
from tidewright.operators import extraction, layout, payslip, provenance, reconcile, report
from tidewright.session import ready, settled, spread
from tidewright.sources import files, store, tokens
from tidewright.streaming import pages

QUERIES, ORACLES = {}, {}

#: What both engines compute of a customer: the numbers that documents are rendered from.
SEED = """SELECT CAST(c_custkey AS BIGINT) AS doc_id, CAST(c_custkey AS BIGINT) AS ck, c_name, c_mktsegment, c_acctbal,
 CAST(8000 + 100 * (c_custkey * 37 % 180) AS DOUBLE) AS salary, CAST(1 + c_custkey % 12 AS INT) AS month, CAST(2010 + c_custkey % 20 AS INT) AS year, CAST(1 + c_custkey % 28 AS INT) AS day FROM customer"""


def seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark).read.parquet(f"{sf_dir}/customer.parquet").createOrReplaceTempView("tidewright_customer")
    return spark.sql(SEED.replace("FROM customer", "FROM tidewright_customer"))


def query(sql: str | None = None, name: str | None = None):
    def register(f):
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(seed(spark, sf_dir))
        if sql:
            ORACLES[key] = f"WITH seed AS ({SEED}){sql}" if sql.startswith(",") else f"WITH seed AS ({SEED})\n{sql}"
        return f

    return register


def cents(x: Column, digits: int = 2) -> Column:
    return F.floor(x * float(10**digits) + 0.5) / float(10**digits)


def r2(x: str, digits: int = 2) -> str:
    return f"floor(({x}) * {10**digits}e0 + 5e-1) / {10**digits}e0"


def comma(x: Column, digits: int = 2) -> Column:
    return F.format_number(x, digits)


# ---------------------------------------------------------------- numbers and dates as text


def _written(s: DataFrame) -> DataFrame:
    """Each salary as it may be written, by customer."""
    whole = comma(F.col("salary"), 0)
    forms = [whole, F.translate(whole, ",", "."), F.translate(whole, ",", " "), F.concat(F.lit("₪"), comma(F.col("salary"))), F.concat(F.translate(whole, ",", "."), F.lit(",00")), F.concat(F.lit("("), whole, F.lit(")")), F.concat(F.lit("-"), whole, F.lit(" ILS"))]
    pick = F.lit(None).cast("string")
    for i, form in enumerate(forms[:6]):
        pick = F.when(F.col("ck") % 6 == i, form).otherwise(pick)
    return s.withColumn("raw", pick)


@query("SELECT doc_id, CASE WHEN ck % 6 = 5 THEN -salary ELSE salary END AS value, 96e-2 AS confidence FROM seed")
def normalize_financial(s: DataFrame) -> DataFrame:
    w = _written(s)
    v = text.financial(F.col("raw"), "amount")
    return w.select("doc_id", v["value"].alias("value"), cents(v["confidence"]).alias("confidence"))


@query("SELECT doc_id, CASE ck % 3 WHEN 0 THEN (ck % 20) / 100e0 WHEN 1 THEN (ck % 20 + 5e-1) / 100e0 ELSE CAST(ck % 2 AS DOUBLE) END AS value, ck % 3 < 2 AS percent FROM seed")
def normalize_rate(s: DataFrame) -> DataFrame:
    raw = F.expr("CASE ck % 3 WHEN 0 THEN concat(ck % 20, '%') WHEN 1 THEN concat(ck % 20, ',5%') ELSE concat(ck % 2, '.0') END")
    v = text.financial(raw, "rate")
    return s.select("doc_id", v["value"].alias("value"), v["percent"].alias("percent"))


@query("SELECT doc_id, CASE ck % 3 WHEN 0 THEN '1' || substr(CAST(1000 + ck AS VARCHAR), 2) WHEN 1 THEN ck || '01' ELSE 'ILl' || ck % 10 END AS digits FROM seed")
def ocr_digit_repair(s: DataFrame) -> DataFrame:
    """Zeros and ones that were read as letters; a text with more such letters than digits stays."""
    raw = F.expr("CASE ck % 3 WHEN 0 THEN concat('I', substr(CAST(1000 + ck AS STRING), 2)) WHEN 1 THEN concat(ck, if(ck < 10, '0l', 'O|')) ELSE concat('ILl', ck % 10) END")
    return s.select("doc_id", text.ocr_digits(raw).alias("digits"))


@query("SELECT doc_id, ck % 4 < 3 AS negative, CASE ck % 4 WHEN 2 THEN '' || ck ELSE '' || ck END AS unsigned_ FROM seed")
def sign_split(s: DataFrame) -> DataFrame:
    raw = F.expr("CASE ck % 4 WHEN 0 THEN concat('-', ck) WHEN 1 THEN concat('(', ck, ')') WHEN 2 THEN concat('−', ck) ELSE concat('', ck) END")
    negative, unsigned = text.sign(raw)
    return s.select("doc_id", negative.alias("negative"), unsigned.alias("unsigned_"))


@query("SELECT doc_id, CASE ck % 5 WHEN 0 THEN ck || '.25' WHEN 1 THEN ck || '.25' WHEN 2 THEN ck || '250' WHEN 3 THEN ck || '250000' ELSE ck || '250.5' END AS plain FROM seed")
def separator_resolve(s: DataFrame) -> DataFrame:
    raw = F.expr("CASE ck % 5 WHEN 0 THEN concat(ck, ',25') WHEN 1 THEN concat(ck, '.25') WHEN 2 THEN concat(ck, ',250') WHEN 3 THEN concat(ck, ',250,000') ELSE concat(ck, '.250,5') END")
    return s.select("doc_id", text.plain_decimal(raw).alias("plain"))


@query("SELECT doc_id, i AS place, unnest_ AS fragment FROM (SELECT doc_id, unnest([0, 1, 2, 3, 4]) AS i, unnest([format('{:,}', CAST(salary AS BIGINT)), '₪ ' || ck || '.50', ck % 10 || '.5' || chr(8239) || '%', (ck % 9 + 1) || chr(8201) || '234', (ck % 9 + 1) || chr(160) || '567' || chr(8239) || '890']) AS unnest_ FROM seed)")
def numeric_fragments(s: DataFrame) -> DataFrame:
    line = F.concat(F.lit("Sum "), comma(F.col("salary"), 0), F.lit(" of ₪ "), F.col("ck"), F.lit(".50 and O, at "), F.col("ck") % 10, F.lit(".5\u202f% I, "), F.col("ck") % 9 + 1, F.lit("\u2009234; "), F.col("ck") % 9 + 1, F.lit("\u00a0567\u202f890"))
    return s.select("doc_id", F.posexplode(text.fragments(line)).alias("place", "fragment"))


@query("SELECT doc_id, i AS place, f AS fragment FROM (SELECT doc_id, unnest([0, 1]) AS i, unnest([format('{:,}', CAST(salary AS BIGINT)), '-' || ck || '.50']) AS f FROM seed)")
def amount_fragments(s: DataFrame) -> DataFrame:
    line = F.concat(F.lit("Sum "), comma(F.col("salary"), 0), F.lit(" und -"), F.col("ck"), F.lit(".50 pay"))
    return s.select("doc_id", F.posexplode(text.fragments(line, text.AMOUNT)).alias("place", "fragment"))


@query("SELECT doc_id, i AS place, f AS fragment FROM (SELECT doc_id, unnest([0, 1]) AS i, unnest([ck % 10 || '.25%', ck % 7 || chr(8201) || '%']) AS f FROM seed)")
def percentage_fragments(s: DataFrame) -> DataFrame:
    line = F.concat(F.lit("fee "), F.col("ck") % 10, F.lit(".25% of "), F.col("ck"), F.lit(", "), F.col("ck") % 7, F.lit("\u2009% more"))
    return s.select("doc_id", F.posexplode(text.fragments(line, text.PERCENTAGE)).alias("place", "fragment"))


@query("SELECT doc_id, CASE WHEN ck % 3 = 2 THEN NULL WHEN ck % 3 = 0 THEN lpad('' || day, 2, '0') || '/' || lpad('' || month, 2, '0') || '/' || year ELSE lpad('' || month, 2, '0') || '/' || year END AS display, CASE WHEN ck % 3 = 2 THEN NULL ELSE year * 372 + month * 31 + CASE WHEN ck % 3 = 0 THEN day ELSE 0 END END AS key FROM seed")
def parse_date(s: DataFrame) -> DataFrame:
    raw = F.expr("CASE ck % 3 WHEN 0 THEN concat('on ', day, '.', month, '.', year, ', 1') WHEN 1 THEN concat('in ', month, '-', year) ELSE concat('no ', month, '/19', day) END")
    d = text.parse_date(raw)
    return s.select("doc_id", d["display"].alias("display"), d["key"].alias("key"))


@query("SELECT doc_id, CASE WHEN ck % 2 = 0 THEN year * 12 + month ELSE 0 END AS key FROM seed")
def month_key(s: DataFrame) -> DataFrame:
    raw = F.expr("CASE WHEN ck % 2 = 0 THEN concat('period ', month, '/', year) ELSE concat(month, ' of ', year) END")
    return s.select("doc_id", text.month_key(raw).alias("key"))


@query("SELECT doc_id, trim(regexp_replace(lower(c_name || ' \"' || c_mktsegment || '\" (' || salary || ')'), '[^0-9a-z%.,/\\-]+', ' ', 'g')) || ' שכר ש ח' AS searched FROM seed".replace("\\\\", "\\"))
def normalize_search_text(s: DataFrame) -> DataFrame:
    raw = F.concat(F.col("c_name"), F.lit(' "'), F.col("c_mktsegment"), F.lit('" ('), F.col("salary").cast("string"), F.lit(") שכר: ש״ח"))
    return s.select("doc_id", text.search_text(raw).alias("searched"))


@query("SELECT doc_id, CASE ck % 4 WHEN 0 THEN -18e-1 WHEN 1 THEN 45e-2 WHEN 2 THEN -18e-1 ELSE 0e0 END AS score FROM seed")
def period_context_score(s: DataFrame) -> DataFrame:
    words = F.expr("CASE ck % 4 WHEN 0 THEN 'annual sum' WHEN 1 THEN 'per current month' WHEN 2 THEN 'monthly ytd' ELSE 'other' END")
    return s.select("doc_id", text.period_score(words).alias("score"))


@query("SELECT doc_id, CASE ck % 4 WHEN 0 THEN 'pensionable_salary_en' WHEN 1 THEN 'insured_salary' WHEN 2 THEN 'insured_salary' END AS alias_id, CASE ck % 4 WHEN 3 THEN 1 ELSE 2 END AS anchors FROM seed")
def alias_match(s: DataFrame) -> DataFrame:
    """The first label in the dictionary's order, wherever it stands in the row."""
    line = F.expr("CASE ck % 4 WHEN 0 THEN 'Pensionable  Salary: 1, severance' WHEN 1 THEN 'שכר מבוטח severance' WHEN 2 THEN 'insured salary שכר מבוטח severance' ELSE 'severance' END")
    searched = text.search_text(line)
    return s.select("doc_id", text.first_label(searched, "insuredSalary").alias("alias_id"), text.anchor_count(searched, "payslip").alias("anchors"))


@query("SELECT doc_id, ck % 2 + 1 AS anchors FROM seed")
def anchor_count(s: DataFrame) -> DataFrame:
    line = F.expr("CASE ck % 2 WHEN 0 THEN 'Deposit fee 1' ELSE 'Closing balance 5, balance fee 1' END")
    return s.select("doc_id", text.anchor_count(text.search_text(line), "report").alias("anchors"))


@query("SELECT doc_id, CASE WHEN a >= 1e6 THEN format('₪{:.2f} מיליון', a / 1e6) WHEN a >= 1e5 THEN format('₪{:.0f} אלף', a / 1e3) WHEN a >= 1e3 THEN format('₪{:.1f} אלף', a / 1e3) ELSE format('{:,}', CAST(a AS BIGINT)) || ' ₪' END AS money, format('{:.1f}', (ck % 90) * 1.2) AS percent, CASE WHEN ck % 4 = 0 THEN '' || (60 + ck % 9) ELSE (60 + ck % 9) || ' ו־' || (3 * (ck % 4)) || ' חודשים' END AS age FROM (SELECT *, CASE ck % 4 WHEN 0 THEN salary * 125 WHEN 1 THEN salary * 5 + 1 WHEN 2 THEN salary ELSE CAST(ck % 900 AS DOUBLE) END AS a FROM seed)")
def formats(s: DataFrame) -> DataFrame:
    amount = F.expr("CASE ck % 4 WHEN 0 THEN salary * 125 WHEN 1 THEN salary * 5 + 1 WHEN 2 THEN salary ELSE CAST(ck % 900 AS DOUBLE) END")
    years = 60 + F.col("ck") % 9 + (F.col("ck") % 4) * 0.25
    return s.select("doc_id", text.money(amount).alias("money"), text.percent((F.col("ck") % 90) * 0.012).alias("percent"), text.age(years).alias("age"))


# ---------------------------------------------------------------- tokens and rows


@query("SELECT doc_id, i AS ord, CAST(i * 18 AS DOUBLE) AS y, t AS text, CAST(greatest(40, length(t) * 7) AS DOUBLE) AS width, 1 AS page FROM (SELECT doc_id, unnest([0, 1, 2]) AS i, unnest([c_name, c_mktsegment, 'end']) AS t FROM seed)")
def src_text_lines(s: DataFrame) -> DataFrame:
    lines = F.concat(F.col("c_name"), F.lit("\r\n\n"), F.col("c_mktsegment"), F.lit("\nend\n"))
    return tokens.of_document(s.select("doc_id", lines.alias("text"))).select("doc_id", "ord", "y", "text", "width", "page")


_WORD = "struct<text:string,bbox:struct<x0:double,y0:double,x1:double,y1:double>,confidence:double,symbols:array<struct<text:string,bbox:struct<x0:double,y0:double,x1:double,y1:double>,confidence:double>>>"
_PAGE = f"array<struct<page_number:int,tokens:array<struct<text:string,x:double,y:double,width:double,height:double,confidence:double,bbox:struct<x0:double,y0:double,x1:double,y1:double>>>,blocks:array<struct<paragraphs:array<struct<lines:array<struct<words:array<{_WORD}>>>>>>>>>"


def _nested(first: str, second: str) -> Column:
    """Both pages in one array of the full type, by way of JSON."""
    texts = F.concat(F.lit("["), F.to_json(F.expr(first)), F.lit(","), F.to_json(F.expr(second)), F.lit("]"))
    return F.from_json(texts, _PAGE)


def _pages(s: DataFrame) -> DataFrame:
    """Two pages: one with tokens, one with blocks of words only; every third document has none and is read as text."""
    first = "named_struct('page_number', 1, 'tokens', array(named_struct('text', concat(' ', c_name), 'x', 10e0, 'y', CAST(NULL AS DOUBLE), 'width', CAST(NULL AS DOUBLE), 'height', CAST(NULL AS DOUBLE), 'confidence', 80e0, 'bbox', named_struct('x0', 1e0, 'y0', 20e0, 'x1', 50e0, 'y1', 24e0))), 'blocks', NULL)"
    box = "named_struct('x0', 5e0, 'y0', 7e0, 'x1', 45e0, 'y1', 30e0)"
    second = f"named_struct('page_number', 2, 'tokens', NULL, 'blocks', array(named_struct('paragraphs', array(named_struct('lines', array(named_struct('words', array(named_struct('text', c_mktsegment, 'bbox', {box}, 'confidence', 5e-1, 'symbols', array(named_struct('text', '7', 'bbox', {box}, 'confidence', 9e-1)))))))))))"
    return s.select("doc_id", "ck", F.col("c_name").alias("text"), F.when(F.col("ck") % 3 != 0, _nested(first, second)).alias("pages"))


@query("""SELECT doc_id, i AS ord, t AS text, x, y, width, height, c AS confidence, page FROM (SELECT doc_id, unnest([0, 1, 2]) AS i, unnest([c_name, c_mktsegment, '7']) AS t, unnest([10e0, 5e0, 5e0]) AS x, unnest([20e0, 7e0, 7e0]) AS y,
 unnest([40e0, 40e0, 40e0]) AS width, unnest([8e0, 23e0, 23e0]) AS height, unnest([8e-1, 5e-1, 9e-1]) AS c, unnest([1, 2, 2]) AS page FROM seed WHERE ck % 3 <> 0)
 UNION ALL SELECT doc_id, 0, c_name, 0e0, 0e0, CAST(greatest(40, length(c_name) * 7) AS DOUBLE), 14e0, 96e-2, 1 FROM seed WHERE ck % 3 = 0""")
def src_tokens_nested(s: DataFrame) -> DataFrame:
    return tokens.of_document(_pages(s)).select("doc_id", "ord", "text", "x", "y", "width", "height", "confidence", "page")


@query("SELECT doc_id, unnest([0, 1]) AS place, unnest([c_mktsegment, '7']) AS word FROM seed WHERE ck % 3 <> 0")
def src_flatten_words(s: DataFrame) -> DataFrame:
    out = _pages(s).select("doc_id", F.posexplode(tokens.words_of_blocks(F.col("pages")[1]["blocks"])).alias("place", "w"))
    return out.select("doc_id", "place", F.col("w.text").alias("word"))


@query("SELECT doc_id, c_name AS text, 10e0 AS x, CAST(ck % 9 AS DOUBLE) AS y, greatest(8e0, CAST(ck % 20 AS DOUBLE)) AS height, 99e-2 AS confidence FROM seed")
def src_pdf_tokens(s: DataFrame) -> DataFrame:
    items = F.expr("array(named_struct('text', concat(c_name, ' '), 'transform', array(1e0, 0e0, 0e0, 1e0, 10e0, CAST(ck % 9 AS DOUBLE)), 'width', 30e0, 'height', -CAST(ck % 20 AS DOUBLE)), named_struct('text', '  ', 'transform', array(1e0, 0e0, 0e0, 1e0, 0e0, 0e0), 'width', 1e0, 'height', 1e0))")
    return s.select("doc_id", F.explode(tokens.of_pdf_items(items, F.lit(1))).alias("t")).select("doc_id", "t.text", "t.x", "t.y", "t.height", "t.confidence")


@query("SELECT doc_id, 2e0 AS x, CAST(ck % 30 AS DOUBLE) AS y, CASE WHEN ck % 2 = 0 THEN 55e-2 ELSE 92e-2 END AS confidence, 12e0 AS height FROM seed")
def normalize_token(s: DataFrame) -> DataFrame:
    t = F.expr("named_struct('text', c_name, 'x', CAST(NULL AS DOUBLE), 'y', CAST(ck % 30 AS DOUBLE), 'width', CAST(NULL AS DOUBLE), 'height', CAST(NULL AS DOUBLE), 'confidence', CASE WHEN ck % 2 = 0 THEN 55e0 END, 'bbox', named_struct('x0', 2e0, 'y0', 0e0, 'x1', 9e0, 'y1', CAST(NULL AS DOUBLE)))")
    return s.select("doc_id", tokens.normalized(t, F.lit(1)).alias("t")).select("doc_id", "t.x", "t.y", "t.confidence", "t.height")


#: Five lines of three words each, whose words are up to 4 units off their line's height; the third word stands first.
_GRID = "SELECT doc_id, line, word, CAST(line * 20 + (ck * 7 + line * 3 + word * 5) % 5 AS DOUBLE) AS y, CAST((3 - word) * 60 AS DOUBLE) AS x, 'w' || line || word || '-' || ck AS text, 5e-1 + word * 1e-1 AS confidence FROM (SELECT *, unnest([0, 1, 2]) AS word FROM (SELECT *, unnest([0, 1, 2, 3, 4]) AS line FROM seed))"


def _grid(s: DataFrame) -> DataFrame:
    out = s.withColumn("line", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("word", F.explode(F.sequence(F.lit(0), F.lit(2))))
    return out.selectExpr("doc_id", "line * 3 + word AS ord", "CAST((3 - word) * 60 AS DOUBLE) AS x", "CAST(line * 20 + (ck * 7 + line * 3 + word * 5) % 5 AS DOUBLE) AS y", "50e0 AS width", "10e0 AS height", "5e-1 + word * 1e-1 + ck % 5 / 1e2 AS confidence", "1 AS page", "concat('w', line, word, '-', ck) AS text")


@query(f", g AS ({_GRID}) SELECT doc_id, line AS row, {r2('avg(y)', 6)} AS y, string_agg(text, ' ' ORDER BY x) AS direct_text, string_agg(text, ' ' ORDER BY x DESC) AS reverse_text FROM g GROUP BY doc_id, line")
def build_rows(s: DataFrame) -> DataFrame:
    return layout.build_rows(_grid(s)).select("doc_id", "row", cents(F.col("y"), 6).alias("y"), "direct_text", "reverse_text")


@query("SELECT doc_id, unnest([0, 1, 2, 3, 4]) AS row, floor((6e-1 + ck % 5 / 1e2) * 1e6 + 5e-1) / 1e6 AS confidence FROM seed")
def row_confidence(s: DataFrame) -> DataFrame:
    return layout.build_rows(_grid(s)).select("doc_id", "row", cents(layout.row_confidence(F.col("tokens")), 6).alias("confidence"))


@query(f", g AS (SELECT doc_id, line AS row, avg(y) AS y FROM ({_GRID}) GROUP BY doc_id, line) SELECT a.doc_id, a.row AS anchor, b.row, row_number() OVER (PARTITION BY a.doc_id, a.row ORDER BY abs(a.y - b.y), abs(a.row - b.row), b.row) AS near FROM g a JOIN g b ON a.doc_id = b.doc_id AND (abs(a.y - b.y) <= 72 OR abs(a.row - b.row) <= 2) QUALIFY near <= 5")
def row_neighborhood(s: DataFrame) -> DataFrame:
    rows = layout.build_rows(_grid(s))
    anchored = rows.select("doc_id", F.lit("any").alias("field"), F.col("row").alias("anchor"), F.col("page").alias("anchor_page"), F.col("y").alias("anchor_y"))
    return layout.neighborhood(anchored, rows).select("doc_id", "anchor", "row", "near")


@query(f", g AS (SELECT doc_id, line AS row, string_agg(text, ' ' ORDER BY x) AS t FROM ({_GRID}) GROUP BY doc_id, line) SELECT a.doc_id, a.row, string_agg(b.t, '|' ORDER BY b.row) AS texts FROM g a JOIN g b ON a.doc_id = b.doc_id AND abs(a.row - b.row) <= 1 GROUP BY a.doc_id, a.row")
def nearby_rows(s: DataFrame) -> DataFrame:
    out = report.nearby_rows(layout.build_rows(_grid(s)), 1)
    return out.select("doc_id", "row", F.array_join(F.transform("nearby", lambda n: n["direct_text"]), "|").alias("texts"))


def _labelled(s: DataFrame) -> DataFrame:
    """A label with two numbers in its row, and one in the row below."""
    row = lambda o, x, y, t: F.struct(F.lit(o).alias("ord"), F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"), t.alias("text"))
    words = F.array(row(0, 0, 0, F.lit("Employee contribution")), row(1, 300, 0, comma(F.col("salary") * 0.07)), row(2, 400, 0, F.lit("7%")), row(3, 300, 30, F.lit("12")))
    return s.select("doc_id", F.explode(words).alias("t")).select("doc_id", "t.*", F.lit(100.0).alias("width"), F.lit(10.0).alias("height"), F.lit(0.9).alias("confidence"), F.lit(1).alias("page"))


@query(f"SELECT doc_id, unnest([0, 0, 1]) AS row, unnest(['p1-r0-t1-n0', 'p1-r0-t2-n0', 'p1-r1-t0-n0']) AS id, unnest([{r2('salary * 7e-2')}, 7e0, 12e0]) AS amount, unnest([false, true, false]) AS explicit FROM seed")
def row_candidates(s: DataFrame) -> DataFrame:
    out = layout.row_candidates(layout.build_rows(_labelled(s)))
    return out.select("doc_id", "row", "id", cents(F.col("amount.value")).alias("amount"), "explicit")


@query(f"SELECT doc_id, unnest(['p1-r0-t1-n0', 'p1-r0-t2-n0', 'p1-r1-t0-n0']) AS id, unnest([{r2('92e-2 - 300 / 900e0', 6)}, 55e-2, 72e-2]) AS score FROM seed")
def distance_score(s: DataFrame) -> DataFrame:
    out = layout.row_candidates(layout.build_rows(_labelled(s)))
    return out.select("doc_id", "id", cents(layout.distance_score(F.col("tokens"), F.col("raw")), 6).alias("score"))


@query(f"SELECT doc_id, unnest(['amount', 'rate']) AS kind, unnest(['p1-r0-t1-n0', 'p1-r0-t2-n0']) AS id, unnest([{r2('9e-1 * 35e-2 + 9e-1 * 25e-2 + (92e-2 - 300 / 900e0) * 25e-2 + 96e-2 * 15e-2', 6)}, {r2('9e-1 * 35e-2 + 9e-1 * 25e-2 + 55e-2 * 25e-2 + 96e-2 * 15e-2', 6)}]) AS score FROM seed UNION ALL SELECT doc_id, 'rate', 'p1-r1-t0-n0', {r2('9e-1 * 35e-2 + 9e-1 * 25e-2 + 72e-2 * 25e-2 + 96e-2 * 15e-2', 6)} FROM seed")
def score_candidate(s: DataFrame) -> DataFrame:
    """12 is too small for an amount, and a rate of 12 %."""
    out = layout.scored(layout.row_candidates(layout.build_rows(_labelled(s))))
    return out.select("doc_id", "kind", "id", cents(F.col("score"), 6).alias("score"))


# ---------------------------------------------------------------- payslips


def payslip_text() -> Column:
    """A payslip of ten lines or fewer; by customer a rate, an amount, or their agreement is missing, or there is a yearly sum too."""
    pay = lambda x: comma(F.col("salary") * x)
    employee = F.expr("CASE ck % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'R' WHEN 2 THEN 'X' ELSE 'B' END")
    line = F.when(employee == "A", pay(0.07)).when(employee == "R", F.lit("7%")).when(employee == "X", F.concat(pay(0.07), F.lit(" 5%"))).otherwise(F.concat(pay(0.07), F.lit(" 7%")))
    gap = F.lit("\n-" * 4 + "\n")  # four rows without a number: labels see their own numbers only
    parts = [F.lit("Payroll month "), F.lpad(F.col("month").cast("string"), 2, "0"), F.lit("/"), F.col("year").cast("string"), gap, F.lit("Gross salary "), comma(F.col("salary") * 1.1), gap, F.lit("Insured salary "), comma(F.col("salary"))]
    parts += [F.when(F.col("ck") % 7 == 0, F.concat(gap, F.lit("Insured salary yearly "), comma(F.col("salary") * 12))).otherwise(F.lit(""))]
    parts += [gap, F.lit("Employee contribution "), line, gap, F.lit("Employer contribution "), pay(0.065), F.lit(" 6.5%"), gap, F.lit("Severance "), pay(0.0833), F.lit(" 8.33%")]
    return F.concat(*parts)


def payslips(s: DataFrame) -> DataFrame:
    return tokens.of_document(s.select("doc_id", payslip_text().alias("text")))


_EXPECTED = """, k AS (SELECT *, CASE ck % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'R' WHEN 2 THEN 'X' ELSE 'B' END AS c FROM seed), f AS (
 SELECT doc_id, c, salary, 'insuredSalary' AS name, salary AS v, 'direct' AS origin, 'not-checked' AS validation, false AS confirm FROM k
 UNION ALL SELECT doc_id, c, salary, 'grossSalary', salary * 11e-1, 'direct', 'not-checked', false FROM k
 UNION ALL SELECT doc_id, c, salary, 'employeeContributionAmount', salary * 7e-2, CASE c WHEN 'R' THEN 'derived' ELSE 'direct' END, CASE c WHEN 'B' THEN 'amount-rate-agree' WHEN 'X' THEN 'amount-rate-conflict' WHEN 'A' THEN 'single-observation' ELSE 'derived-from-insured-salary' END, c = 'X' FROM k
 UNION ALL SELECT doc_id, c, salary, 'employeeContributionRate', 7e-2, CASE WHEN c IN ('A', 'X') THEN 'derived' ELSE 'direct' END, CASE c WHEN 'B' THEN 'amount-rate-agree' WHEN 'X' THEN 'amount-rate-conflict' WHEN 'R' THEN 'single-observation' ELSE 'derived-from-insured-salary' END, c = 'X' FROM k
 UNION ALL SELECT doc_id, c, salary, 'employerContributionAmount', salary * 65e-3, 'direct', 'amount-rate-agree', false FROM k
 UNION ALL SELECT doc_id, c, salary, 'employerContributionRate', 65e-3, 'direct', 'amount-rate-agree', false FROM k
 UNION ALL SELECT doc_id, c, salary, 'severanceContributionAmount', salary * 833e-4, 'direct', 'amount-rate-agree', false FROM k
 UNION ALL SELECT doc_id, c, salary, 'severanceRate', 833e-4, 'direct', 'amount-rate-agree', false FROM k)"""


@query(f"{_EXPECTED} SELECT f.doc_id, name, {r2('v', 4)} AS value_num, NULL AS value_str, lpad('' || month, 2, '0') || '/' || year AS source_date, origin, validation, confirm FROM f JOIN seed USING (doc_id) UNION ALL SELECT doc_id, 'payslipMonth', NULL, lpad('' || month, 2, '0') || '/' || year, lpad('' || month, 2, '0') || '/' || year, 'direct', 'semantic-period-context', false FROM seed")
def parse_payslip(s: DataFrame) -> DataFrame:
    out = payslip.parse(payslips(s))
    return out.select("doc_id", "name", cents(F.col("value_num"), 4).alias("value_num"), "value_str", "source_date", "origin", "validation", "confirm")


@query("SELECT doc_id, lpad('' || month, 2, '0') || '/' || year AS month, 97e-2 AS confidence, true AS clear FROM seed")
def payslip_period(s: DataFrame) -> DataFrame:
    """The month beside its label, and not the month that work began, printed two lines below."""
    more = F.concat(payslip_text(), F.lit("\nDate of birth 01/2001"))
    rows = settled(layout.build_rows(tokens.of_document(s.select("doc_id", more.alias("text")))))
    return payslip.payslip_period(rows, F.lit(False)).select("doc_id", F.col("value").alias("month"), "confidence", "clear")


def _values(s: DataFrame) -> DataFrame:
    return settled(layout.label_values(settled(layout.build_rows(payslips(s)))))


def _solved(s: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    values = _values(s)
    salaries, options = settled(payslip.salary_options(values)), settled(payslip.contribution_options(values))
    return values, salaries, options, settled(payslip.evaluate_tuples(salaries, options))


#: A line's only token gives a number 0.35 * 0.96 + 0.25 * 0.96 + 0.25 * 0.72 + 0.15 * 0.96 as its confidence.
_SURE = "(96e-2 * 35e-2 + 96e-2 * 25e-2 + 72e-2 * 25e-2 + 96e-2 * 15e-2)"


@query(f", k AS (SELECT *, unnest(CASE WHEN ck % 7 = 0 THEN [1e0, 12e0] ELSE [1e0] END) AS times FROM seed) SELECT doc_id, salary * times AS value, {r2(f'{_SURE} * 2 + CASE WHEN times = 12 THEN -18e-1 ELSE 0 END', 6)} AS unary, CAST(CASE WHEN times = 12 THEN 2 ELSE 1 END AS INT) AS choice FROM k")
def salary_options(s: DataFrame) -> DataFrame:
    return payslip.salary_options(_values(s)).select("doc_id", cents(F.col("amount.value")).alias("value"), cents(F.col("unary"), 6).alias("unary"), "choice")


#: What each role's line says (amount, rate), and of that both, the amount alone, the rate alone.
_CHOICES = f""", l AS (
 SELECT doc_id, 'severanceContribution' AS field, {r2('salary * 833e-4')} AS amount, 833e-4 AS rate FROM seed UNION ALL SELECT doc_id, 'employerContribution', {r2('salary * 65e-3')}, 65e-3 FROM seed
 UNION ALL SELECT doc_id, 'employeeContribution', CASE WHEN ck % 5 <> 1 THEN {r2('salary * 7e-2')} END, CASE ck % 5 WHEN 0 THEN NULL WHEN 2 THEN 5e-2 ELSE 7e-2 END FROM seed
), c AS (
 SELECT doc_id, field, amount, rate, {r2(f'2 * {_SURE} + 2e-1', 6)} AS unary, 1 AS place FROM l WHERE amount IS NOT NULL AND rate IS NOT NULL
 UNION ALL SELECT doc_id, field, amount, NULL, {r2(_SURE, 6)}, 2 FROM l WHERE amount IS NOT NULL UNION ALL SELECT doc_id, field, NULL, rate, {r2(_SURE, 6)}, 3 FROM l WHERE rate IS NOT NULL
) SELECT doc_id, field, amount, rate, unary, CAST(row_number() OVER (PARTITION BY doc_id, field ORDER BY place) AS INT) AS choice FROM c"""


@query(_CHOICES, "contribution_options")
def _contribution_options(s: DataFrame) -> DataFrame:
    out = payslip.contribution_options(_values(s))
    return out.select("doc_id", "field", cents(F.col("amount.value")).alias("amount"), F.col("rate.value").alias("rate"), cents(F.col("unary"), 6).alias("unary"), "choice")


@query("SELECT doc_id, field, count AS choices FROM (SELECT doc_id, unnest(['employeeContribution', 'employerContribution', 'severanceContribution']) AS field, unnest([CASE WHEN ck % 5 < 2 THEN 1 ELSE 3 END, 3, 3]) AS count FROM seed)")
def amount_rate_pairs(s: DataFrame) -> DataFrame:
    """Single amounts, single rates, and pairs of different numbers."""
    return payslip.contribution_options(_values(s)).groupBy("doc_id", "field").agg(F.count("*").cast("int").alias("choices"))


@query("SELECT doc_id, CAST(least(6 + ck % 7, 8) AS INT) AS salaries, CAST(least(5 + ck % 4, 5) * least(2 + ck % 4, 4) AS INT) AS pairs, CAST(10 AS INT) AS kept FROM seed")
def top_n_per_group(s: DataFrame) -> DataFrame:
    """More numbers beside a label than count: 8 salaries; 5 amounts and 4 rates of a contribution, whose choices are cut to 10."""
    numbers = lambda n, step, form: F.array_join(F.transform(F.sequence(F.lit(1), n.cast("int")), lambda i: form(i * step)), "; ")
    plain = lambda x: F.concat(F.lit("9"), F.lpad(x.cast("string"), 4, "0"))
    share = lambda x: F.concat(x.cast("string"), F.lit("%"))
    gap = F.lit("\n-" * 4 + "\n")
    line = F.concat(F.lit("Insured salary "), numbers(6 + F.col("ck") % 7, 300, plain), gap, F.lit("Employer contribution "), numbers(5 + F.col("ck") % 4, 7, lambda x: (x + 100).cast("string")), F.lit("; "), numbers(2 + F.col("ck") % 4, 3, share))
    values = settled(layout.label_values(settled(layout.build_rows(tokens.of_document(s.select("doc_id", line.alias("text")))))))
    most = values.filter(f"field = 'employerContribution' and match = 1 and rank <= CASE kind WHEN 'amount' THEN {payslip.AMOUNTS} ELSE {payslip.RATES} END").groupBy("doc_id").agg((F.count_if(F.col("kind") == "amount") * F.count_if(F.col("kind") == "rate")).cast("int").alias("pairs"))
    choices = payslip.contribution_options(values).filter("field = 'employerContribution'").groupBy("doc_id").agg(F.count("*").cast("int").alias("kept"))
    salaries = payslip.salary_options(values).groupBy("doc_id").agg(F.count("*").cast("int").alias("salaries"))
    return salaries.join(most, "doc_id").join(choices, "doc_id").select("doc_id", "salaries", "pairs", "kept")


_SOLUTIONS = "(CASE WHEN ck % 5 < 2 THEN 2 ELSE 4 END) * 16"


@query(f"SELECT doc_id, CAST({_SOLUTIONS} * CASE WHEN ck % 7 = 0 THEN 2 ELSE 1 END AS BIGINT) AS solutions FROM seed")
def evaluate_tuple(s: DataFrame) -> DataFrame:
    """Every choice of each role, or none, is allowed where numbers stand apart; yearly sums are a salary of their own."""
    return _solved(s)[3].groupBy("doc_id").agg(F.count("*").alias("solutions"))


_TUPLE = f"SELECT doc_id, salary, CASE WHEN ck % 5 <> 1 THEN {r2('salary * 7e-2')} END AS employee, CASE WHEN ck % 5 IN (1, 3, 4) THEN 7e-2 END AS employee_rate, false AS ambiguous FROM seed"


@query(_TUPLE)
def global_tuple(s: DataFrame) -> DataFrame:
    best = payslip.global_tuple(_solved(s)[3])
    return best.select("doc_id", F.col("salary.amount.value").alias("salary"), cents(F.col("employee.amount.value")).alias("employee"), F.col("employee.rate.value").alias("employee_rate"), "ambiguous")


@query("SELECT doc_id, ck % 2 = 0 AS ambiguous, CASE WHEN ck % 2 = 0 THEN 'ambiguous-salary-candidates' ELSE 'not-checked' END AS validation FROM seed")
def alt_salary_margin(s: DataFrame) -> DataFrame:
    """Two salaries that fit equally well, unless they are about the same."""
    other = F.when(F.col("ck") % 2 == 0, F.col("salary") * 1.05).otherwise(F.col("salary") + 1)
    pair = F.concat(F.lit("Insured salary "), comma(F.col("salary")), F.lit("\n-\n-\n-\n-\nInsured salary "), comma(other))
    out = payslip.parse(tokens.of_document(s.select("doc_id", pair.alias("text")))).filter("name = 'insuredSalary'")
    return out.select("doc_id", "alternatives", "validation").withColumnRenamed("alternatives", "ambiguous")


@query("SELECT doc_id, CASE WHEN ck % 7 = 0 THEN 2 ELSE 1 END AS salaries, CASE WHEN ck % 5 < 2 THEN 1 ELSE 3 END AS employee, 3 AS employer, 3 AS severance, CAST((CASE WHEN ck % 5 < 2 THEN 2 ELSE 4 END) * 16 * CASE WHEN ck % 7 = 0 THEN 2 ELSE 1 END AS INT) AS solutions FROM seed")
def candidate_counts(s: DataFrame) -> DataFrame:
    _, salaries, options, solutions = _solved(s)
    out = payslip.candidate_counts(salaries, options, payslip.global_tuple(solutions))
    return out.select("doc_id", *[F.col(c).cast("int").alias(c) for c in ("salaries", "employee", "employer", "severance", "solutions")])


@query("SELECT doc_id, 'employee' AS role FROM seed WHERE ck % 5 = 2")
def rejected_conflict(s: DataFrame) -> DataFrame:
    values, _, _, solutions = _solved(s)
    return payslip.rejected_conflicts(values, payslip.global_tuple(solutions))


@query(f"SELECT doc_id, CASE WHEN total < salary * 65e-2 THEN 1 ELSE 0 END AS allowed FROM (SELECT *, salary * 3e-1 * (1 + ck % 3) AS total FROM seed)")
def contribution_sum(s: DataFrame) -> DataFrame:
    """Contributions of 30 % each: two are less than 65 % of the salary, three are not."""
    label = F.array(F.lit("Employee contribution "), F.lit("Employer contribution "), F.lit("Severance "))
    lines = F.array_join(F.transform(F.slice(label, F.lit(1), (1 + F.col("ck") % 3).cast("int")), lambda x: F.concat(x, comma(F.col("salary") * 0.3))), "\n-\n-\n-\n-\n")
    docs = s.select("doc_id", F.concat(F.lit("Insured salary "), comma(F.col("salary")), F.lit("\n-\n-\n-\n-\n"), lines).alias("text"), (1 + F.col("ck") % 3).alias("n"))
    values = settled(layout.label_values(settled(layout.build_rows(tokens.of_document(docs.select("doc_id", "text"))))))
    full = payslip.evaluate_tuples(settled(payslip.salary_options(values)), settled(payslip.contribution_options(values)))
    used = sum((F.col(f"{r}.amount").isNotNull().cast("int") for r in payslip.ROLES), F.lit(0))
    most = full.groupBy("doc_id").agg(F.max(used).alias("used"))
    return docs.join(most, "doc_id").select("doc_id", (F.col("used") == F.col("n")).cast("int").alias("allowed"))


@query("SELECT doc_id, unnest([lpad('' || month, 2, '0') || '/' || year, '01/2001']) AS value, unnest([2e-1 + 31e-1 - 14e-2, 2e-1 - 28e-1 + 19e-2]) AS score, unnest([true, false]) AS positive, unnest([false, true]) AS negative FROM (SELECT * REPLACE (month AS month) FROM seed)".replace("31e-1 - 14e-2", "31e-1 - (5e-1 - 36 / 180e0)").replace("28e-1 + 19e-2", "28e-1 + (55e-2 - 36 / 180e0)"))
def period_context(s: DataFrame) -> DataFrame:
    """A row's own words in full, those of the row two lines away by distance."""
    pair = F.concat(F.lit("Payroll month "), F.lpad(F.col("month").cast("string"), 2, "0"), F.lit("/"), F.col("year"), F.lit("\n-\nDate of birth 01/2001"))
    out = payslip.period_candidates(settled(layout.build_rows(tokens.of_document(s.select("doc_id", pair.alias("text"))))))
    return out.select("doc_id", "value", "score", "positive", "negative")


@query("SELECT doc_id, '05/2020' AS value, CASE WHEN ck % 2 = 0 THEN 0e0 ELSE 45e-2 END AS score FROM seed")
def period_ties(s: DataFrame) -> DataFrame:
    """Of rows as far from a month, above and below, the upper one counts first: a date of birth as the fifth row, or words on periods in the sixth."""
    word = lambda o, y, t: F.struct(F.lit(o).alias("ord"), F.lit(float(y)).alias("y"), t.alias("text"))
    top, last = F.when(F.col("ck") % 2 == 0, "date of birth").otherwise("pay period"), F.when(F.col("ck") % 2 == 0, "pay period").otherwise("date of birth")
    words = F.array(word(0, 46, top), word(1, 64, F.lit("-")), word(2, 82, F.lit("-")), word(3, 100, F.lit("05/2020")), word(4, 127, F.lit("-")), word(5, 154, last))
    found = s.select("doc_id", F.explode(words).alias("t")).select("doc_id", "t.*", F.lit(0.0).alias("x"), F.lit(100.0).alias("width"), F.lit(10.0).alias("height"), F.lit(0.9).alias("confidence"), F.lit(1).alias("page"))
    return payslip.period_candidates(settled(layout.build_rows(found))).select("doc_id", "value", cents(F.col("score"), 6).alias("score"))


@query("SELECT doc_id, '05/2020' AS value, CASE WHEN ck % 2 = 0 THEN 68e-2 ELSE 97e-2 END AS confidence FROM seed".replace("68e-2", "58e-2"))
def runner_up_margin(s: DataFrame) -> DataFrame:
    """A month whose label another month shares, or has no label either, isn't clear."""
    pair = F.when(F.col("ck") % 2 == 0, F.lit("05/2020\n-\n-\n-\n-\n06/2020")).otherwise(F.lit("Pay period 05/2020\n-\n-\n-\n-\n06/2020"))
    out = payslip.payslip_period(settled(layout.build_rows(tokens.of_document(s.select("doc_id", pair.alias("text"))))), F.lit(False))
    return out.select("doc_id", "value", "confidence")


#: By how much an employee's amount and rate differ from one clear number: alone or derived, both of these beside a number that contradicts them, or agreeing.
_EMPLOYEE = ["CASE WHEN ck % 5 = 0 THEN 0e0 WHEN ck % 5 = 1 THEN -3e-2 WHEN ck % 5 = 2 THEN -8e-2 ELSE 5e-2 END", "CASE WHEN ck % 5 = 0 THEN -3e-2 WHEN ck % 5 = 1 THEN 0e0 WHEN ck % 5 = 2 THEN -11e-2 ELSE 5e-2 END"]


@query(f"""SELECT doc_id, name, 'pdf-text' AS method, alias AS alias_id, 1 AS page, {r2('confidence', 6)} AS confidence, origin FROM (SELECT doc_id,
 unnest(['insuredSalary', 'grossSalary', 'employeeContributionAmount', 'employeeContributionRate', 'employerContributionAmount', 'employerContributionRate', 'severanceContributionAmount', 'severanceRate', 'payslipMonth']) AS name,
 unnest(['insured_salary_en', 'gross_salary_en', 'employee_contribution_en', 'employee_contribution_en', 'employer_contribution_en', 'employer_contribution_en', 'severance_en', 'severance_en', 'month-pattern']) AS alias,
 unnest(['direct', 'direct', CASE WHEN ck % 5 = 1 THEN 'derived' ELSE 'direct' END, CASE WHEN ck % 5 IN (0, 2) THEN 'derived' ELSE 'direct' END, 'direct', 'direct', 'direct', 'direct', 'direct']) AS origin,
 unnest([{_SURE}, {_SURE}, {_SURE} + {_EMPLOYEE[0]}, {_SURE} + {_EMPLOYEE[1]}, {_SURE} + 5e-2, {_SURE} + 5e-2, {_SURE} + 5e-2, {_SURE} + 5e-2, 97e-2]) AS confidence FROM seed)""")
def diagnostics(s: DataFrame) -> DataFrame:
    out = payslip.diagnostics(payslip.parse(payslips(s)))
    return out.select("doc_id", "name", "method", "alias_id", "page", cents(F.col("confidence"), 6).alias("confidence"), "origin")


_ITEM = "named_struct('value', {0}, 'unit', 'u', 'origin', 'direct', 'confidence', {1}, 'confirm', false, 'alias_id', 'a', 'page', 1, 'candidate_id', 'c', 'validation', 'v', 'alternatives', false, 'rejected', false)"


@query(f"SELECT doc_id, {r2('CASE ck % 4 WHEN 0 THEN salary * 7e-2 WHEN 1 THEN salary * 7e-2 ELSE salary * 7e-2 END')} AS amount, CASE ck % 4 WHEN 2 THEN 5e-2 ELSE 7e-2 END AS rate, CASE ck % 4 WHEN 0 THEN 85e-2 WHEN 1 THEN 8e-1 WHEN 2 THEN 62e-2 ELSE 77e-2 END AS amount_confidence, CASE ck % 4 WHEN 0 THEN 95e-2 WHEN 1 THEN 77e-2 WHEN 2 THEN 72e-2 ELSE 8e-1 END AS rate_confidence FROM seed")
def cross_validate(s: DataFrame) -> DataFrame:
    """Both agree, the rate is missing, both disagree, the amount is missing."""
    own = F.expr("CASE ck % 4 WHEN 0 THEN 8e-1 WHEN 1 THEN 8e-1 WHEN 2 THEN 8e-1 END")
    amount = F.when(F.col("ck") % 4 != 3, F.expr(_ITEM.format("salary * 7e-2", "8e-1")).cast(payslip.FIELD))
    rate = F.expr(f"CASE ck % 4 WHEN 0 THEN {_ITEM.format('7e-2', '9e-1')} WHEN 2 THEN {_ITEM.format('5e-2', '9e-1')} WHEN 3 THEN {_ITEM.format('7e-2', '8e-1')} END").cast(payslip.FIELD)
    salary = F.expr(_ITEM.format("salary", "9e-1")).cast(payslip.FIELD)
    out = s.select("doc_id", payslip.cross_validate(amount, rate, salary, F.lit(False)).alias("x"), own.alias("own"))
    return out.select("doc_id", cents(F.col("x.amount.value")).alias("amount"), cents(F.col("x.rate.value"), 6).alias("rate"), cents(F.col("x.amount.confidence"), 6).alias("amount_confidence"), cents(F.col("x.rate.confidence"), 6).alias("rate_confidence"))


# ---------------------------------------------------------------- pension reports


def report_text() -> Column:
    """A report: provider, balance, personal fees and the fund's averages, three months of contributions, a yearly sum."""
    pay = lambda x: comma(F.floor(F.col("salary") * x), 0)
    row = lambda m: F.concat(F.lit(f"0{m + 1}/2026 0{m}/2026 "), comma(F.col("salary"), 0), F.lit(" "), pay(0.07), F.lit(" "), pay(0.065), F.lit(" "), pay(0.0833), F.lit(" "), comma(F.floor(F.col("salary") * 0.07) + F.floor(F.col("salary") * 0.065) + F.floor(F.col("salary") * 0.0833), 0))
    lines = [F.lit("Annual report"), F.concat(F.lit("Pension provider: Fund of "), F.col("c_mktsegment")), F.concat(F.lit("Closing balance "), comma(F.col("salary") * 13)), F.lit("-"), F.lit("Personal management fees"), F.concat(F.lit("Deposit fee 0."), F.lpad((10 + F.col("ck") % 80).cast("string"), 2, "0"), F.lit("%")), F.lit("Balance fee 0.16%")]
    lines += [F.lit("-"), F.lit("-"), F.lit("-"), F.lit("Fund average"), F.lit("Deposit fee 1.49%"), F.lit("Balance fee 0.51%"), row(5), row(6), row(7), F.concat(F.lit("Annual 08/2026 "), comma(F.col("salary") * 12, 0), F.lit(" 1,000 2,000 3,000"))]
    return F.concat_ws("\n", *lines)


def _report_rows(s: DataFrame) -> DataFrame:
    return settled(layout.build_rows(tokens.of_document(s.select("doc_id", report_text().alias("text")))))


@query(f"SELECT doc_id, {r2('salary * 13')} AS value, 1e0 AS score FROM seed")
def balance_candidates(s: DataFrame) -> DataFrame:
    return report.closing_balance(_report_rows(s)).select("doc_id", cents(F.col("value")).alias("value"), "score")


@query("SELECT doc_id, unnest(['depositManagementFeeRate', 'balanceManagementFeeRate']) AS field, unnest([floor((10 + ck % 80) / 1e4 * 1e6 + 5e-1) / 1e6, 16e-4]) AS value FROM seed")
def fee_pair(s: DataFrame) -> DataFrame:
    """Personal fees, not the fund's averages beside the same labels."""
    return report.fee_pair(settled(report.fee_candidates(_report_rows(s)))).select("doc_id", "field", cents(F.col("value"), 6).alias("value"))


@query("SELECT doc_id, field, CAST(n AS BIGINT) AS n FROM (SELECT doc_id, unnest(['depositManagementFeeRate', 'balanceManagementFeeRate']) AS field, 4 AS n FROM seed)")
def fee_candidates(s: DataFrame) -> DataFrame:
    """Each of the four percentages has a label of both fees near."""
    return report.fee_candidates(_report_rows(s)).groupBy("doc_id", "field").agg(F.count("*").alias("n"))


@query("SELECT doc_id, floor((11e-1 - apart * 16e-2 + CASE WHEN apart = 0 THEN 75e-2 ELSE 0 END + CASE ck % 3 WHEN 0 THEN 45e-2 WHEN 1 THEN -105e-2 ELSE 0 END - CASE WHEN ck % 2 = 0 THEN 14e-1 ELSE 0 END) * 1e6 + 5e-1) / 1e6 AS score FROM (SELECT *, ck % 6 AS apart FROM seed)")
def fee_score(s: DataFrame) -> DataFrame:
    headed = F.when(F.col("ck") % 3 == 0, True).when(F.col("ck") % 3 == 1, False)
    return s.select("doc_id", cents(report.fee_score(F.col("ck") % 6, headed, F.col("ck") % 2 == 0, F.lit(False)), 6).alias("score"))


@query("SELECT doc_id, 'Fund of ' || c_mktsegment AS value FROM seed")
def extract_provider(s: DataFrame) -> DataFrame:
    return report.provider(_report_rows(s)).select("doc_id", "value")


@query("SELECT doc_id, CASE WHEN ck % 2 = 0 THEN 'Alpha ' || c_mktsegment ELSE 'Beta' END AS value FROM seed")
def next_line(s: DataFrame) -> DataFrame:
    """A provider's name is in the row of its label, else in the next one."""
    line = F.when(F.col("ck") % 2 == 0, F.concat(F.lit("שם הקרן: Alpha "), F.col("c_mktsegment"))).otherwise(F.lit("Fund provider - 12\nBeta"))
    return report.provider(layout.build_rows(tokens.of_document(s.select("doc_id", line.alias("text"))))).select("doc_id", "value")


_HISTORY = "SELECT doc_id, m, salary, floor(salary * 7e-2) AS employee, floor(salary * 65e-3) AS employer, floor(salary * 833e-4) AS severance FROM (SELECT *, unnest([5, 6, 7]) AS m FROM seed)"


@query(f"SELECT doc_id, '0' || (m + 1) || '/2026' AS deposit_date, '0' || m || '/2026' AS month, CAST(2026 * 372 + m * 31 AS INT) AS key, salary, employee, employer, severance, employee + employer + severance AS total FROM ({_HISTORY})")
def contribution_rows(s: DataFrame) -> DataFrame:
    out = report.contribution_rows(_report_rows(s))
    return out.select("doc_id", "deposit_date", "month", "key", "salary", "employee", "employer", "severance", "total")


@query("SELECT doc_id, CASE WHEN ck % 2 = 0 THEN 'forward' ELSE 'reverse' END AS way, 700e0 + ck % 50 AS a, 600e0 AS b, 500e0 AS c FROM seed")
def total_row_detection(s: DataFrame) -> DataFrame:
    a = (700 + F.col("ck") % 50).cast("double")
    total = a + 1100
    side = F.when(F.col("ck") % 2 == 0, F.array(a, F.lit(600.0), F.lit(500.0), total)).otherwise(F.array(total, F.lit(500.0), F.lit(600.0), a))
    out = s.select("doc_id", F.when(F.col("ck") % 2 == 0, "forward").otherwise("reverse").alias("way"), report.split_total(side).alias("x"))
    return out.select("doc_id", "way", F.col("x")[0].alias("a"), F.col("x")[1].alias("b"), F.col("x")[2].alias("c"))


@query(f"SELECT doc_id, '07/2026' AS month, salary FROM seed")
def latest_row(s: DataFrame) -> DataFrame:
    return report.latest_row(settled(report.contribution_rows(_report_rows(s)))).select("doc_id", "month", "salary")


@query("SELECT doc_id, CAST(least(1 + ck % 8, 6) AS BIGINT) AS recent, CAST(least(1 + ck % 8, 6) - CASE WHEN ck % 3 = 0 THEN least(ck % 8, 5) ELSE 0 END AS BIGINT) AS agreeing, least(1 + ck % 8, 6) - CASE WHEN ck % 3 = 0 THEN least(ck % 8, 5) ELSE 0 END >= 2 AS recurring FROM seed")
def recurring_evidence(s: DataFrame) -> DataFrame:
    """One to eight months, of which the latest six count; by customer, all earlier ones had another salary."""
    n = (1 + F.col("ck") % 8).cast("int")
    months = s.withColumn("m", F.explode(F.sequence(F.lit(1), n)))
    pay = F.when((F.col("ck") % 3 == 0) & (F.col("m") < n), F.col("salary") * 0.8).otherwise(F.col("salary"))
    rows = months.select("doc_id", (n - F.col("m")).alias("row"), (2026 * 372 + F.col("m") * 31).alias("key"), pay.alias("salary"), *[(pay * x).alias(m) for m, x in zip(report.MEASURES[1:], (0.07, 0.065, 0.0833), strict=True)])
    return report.recurring_evidence(rows)


_REPORT = f"""SELECT doc_id, name, floor(v * 1e6 + 5e-1) / 1e6 AS value_num, t AS value_str, confidence FROM (SELECT doc_id,
 unnest(['currentBalance', 'depositManagementFeeRate', 'balanceManagementFeeRate', 'pensionProvider', 'latestReportedPensionableSalary', 'latestEmployeeContributionAmount', 'latestEmployerContributionAmount', 'latestSeveranceContributionAmount', 'latestEmployeeContributionRate', 'latestEmployerContributionRate', 'latestSeveranceRate', 'reportDate', 'balanceDate']) AS name,
 unnest([salary * 13, (10 + ck % 80) / 1e4, 16e-4, NULL, salary, floor(salary * 7e-2), floor(salary * 65e-3), floor(salary * 833e-4), floor(salary * 7e-2) / salary, floor(salary * 65e-3) / salary, floor(salary * 833e-4) / salary, NULL, NULL]) AS v,
 unnest([NULL, NULL, NULL, 'Fund of ' || c_mktsegment, NULL, NULL, NULL, NULL, NULL, NULL, NULL, '08/2026', '08/2026']) AS t,
 unnest([97e-2, 95e-2, 95e-2, 9e-1, 97e-2, 97e-2, 97e-2, 97e-2, 96e-2, 96e-2, 96e-2, 82e-2, 8e-1]) AS confidence FROM seed)"""


@query(_REPORT)
def parse_report(s: DataFrame) -> DataFrame:
    docs = s.select("doc_id", report_text().alias("text"))
    out = report.parse(tokens.of_document(docs), docs)
    return out.select("doc_id", "name", cents(F.col("value_num"), 6).alias("value_num"), "value_str", cents(F.col("confidence"), 6).alias("confidence"))


@query("SELECT doc_id, unnest(['depositManagementFeeRate', 'balanceManagementFeeRate', 'pensionProvider']) AS name, unnest([96e-2, 96e-2, 9e-1]) AS confidence, unnest([floor((10 + ck % 80) / 1e4 * 1e6 + 5e-1) / 1e6, 16e-4, NULL]) AS value_num FROM seed")
def fees_from_tokens(s: DataFrame) -> DataFrame:
    docs = tokens.of_document(s.select("doc_id", report_text().alias("text")))
    """Both fees come from the tokens, also the one that the text gave otherwise; other fields stay."""
    text_fields = F.explode(F.array(F.struct(F.lit("depositManagementFeeRate").alias("name"), F.lit(0.5).alias("v"), F.lit(0.95).alias("c")), F.struct(F.lit("pensionProvider").alias("name"), F.lit(None).cast("double").alias("v"), F.lit(0.9).alias("c"))))
    fields = s.select("doc_id", text_fields.alias("x")).select("doc_id", "x.*").withColumns({"value_num": F.col("v"), "value_str": F.lit(None).cast("string"), "unit": F.lit("ratio"), "origin": F.lit("direct"), "confidence": F.col("c"), "alias_id": F.lit("x"), "page": F.lit(1), "source_date": F.lit(None).cast("string"), "recurring": F.lit(False), "confirm": F.lit(False), "method": F.lit("pdf-text")}).drop("v", "c")
    out = report.with_token_fees(fields, docs)
    return out.select("doc_id", "name", "confidence", cents(F.col("value_num"), 6).alias("value_num"))


# ---------------------------------------------------------------- reconciliation

_CASES = "CASE ck % 6 WHEN 0 THEN {0} WHEN 1 THEN {1} WHEN 2 THEN {2} WHEN 3 THEN {3} WHEN 4 THEN {4} ELSE {5} END"


def _two_documents(s: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Agreement; a newer payslip; a newer report; one month with different sums; unreliable dates; a report alone."""
    month = F.expr(_CASES.format("'08/2026'", "'08/2026'", "'05/2026'", "'08/2026'", "'08/2026'", "NULL"))
    sure = F.expr(_CASES.format("9e-1", "9e-1", "9e-1", "9e-1", "5e-1", "NULL"))
    first = s.filter("ck % 6 < 5").select(F.col("doc_id").alias("case_id"), F.lit("insuredSalary").alias("name"), "salary", month.alias("source_date"), sure.alias("date_confidence"))
    first = first.select("case_id", "name", F.col("salary").alias("value_num"), F.lit(None).cast("string").alias("value_str"), F.lit("direct").alias("origin"), F.lit(0.9).alias("confidence"), F.lit(False).alias("confirm"), "source_date", "date_confidence")
    value = F.expr(_CASES.format("salary + 1", "salary * 12e-1", "salary * 12e-1", "salary * 12e-1", "salary * 12e-1", "salary"))
    when = F.expr(_CASES.format("'08/2026'", "'05/2026'", "'08/2026'", "'08/2026'", "'05/2026'", "'08/2026'"))
    second = s.select(F.col("doc_id").alias("case_id"), F.lit("latestReportedPensionableSalary").alias("name"), value.alias("value_num"), F.lit(None).cast("string").alias("value_str"), F.lit("direct").alias("origin"), F.lit(0.88).alias("confidence"), F.lit(False).alias("confirm"), when.alias("salary_month"), F.lit(0.95).alias("date_confidence"))
    balance = s.select(F.col("doc_id").alias("case_id"), F.lit("currentBalance").alias("name"), (F.col("salary") * 13).alias("value_num"), F.lit(None).cast("string").alias("value_str"), F.lit("direct").alias("origin"), F.lit(0.97).alias("confidence"), F.lit(False).alias("confirm"), F.lit(None).cast("string").alias("salary_month"), F.lit(None).cast("double").alias("date_confidence"))
    return first, second.unionByName(balance)


_DECISION = _CASES.format("'CROSS_DOCUMENT_VALIDATION'", "'CHRONOLOGY_RESOLVED'", "'CHRONOLOGY_RESOLVED'", "'CROSS_DOCUMENT_CONFLICT'", "'CROSS_DOCUMENT_CONFLICT'", "'SECOND_ONLY'")


@query(f"SELECT doc_id AS case_id, 'insuredSalary' AS name, CASE WHEN ck % 6 = 2 THEN salary * 12e-1 ELSE salary END AS value_num, {_DECISION} AS decision, {_CASES.format('98e-2', '9e-1', '88e-2', '78e-2', '78e-2', '88e-2')} AS confidence, ck % 6 IN (3, 4) AS confirm FROM seed UNION ALL SELECT doc_id, 'currentBalance', salary * 13, 'SECOND_ONLY', 97e-2, false FROM seed")
def reconcile_documents(s: DataFrame) -> DataFrame:
    out = reconcile.reconcile(*_two_documents(s))
    return out.select("case_id", "name", "value_num", "decision", cents(F.col("confidence"), 6).alias("confidence"), "confirm")


@query("SELECT doc_id AS case_id, ck % 6 IN (3, 4) AS confirm FROM seed")
def requires_confirmation_any(s: DataFrame) -> DataFrame:
    return reconcile.requires_confirmation(reconcile.reconcile(*_two_documents(s)))


def _item(value: str, confidence: str, origin: str = "'direct'", date: str = "NULL", recurring: str = "false", method: str = "'pdf-text'") -> Column:
    return F.expr(f"named_struct('value_num', {value}, 'value_str', NULL, 'origin', {origin}, 'confidence', {confidence}, 'confirm', false, 'source_date', {date}, 'salary_month', NULL, 'date_confidence', NULL, 'recurring', {recurring}, 'method', {method})").cast(reconcile.ITEM)


@query("SELECT doc_id, CASE ck % 3 WHEN 0 THEN salary WHEN 1 THEN salary * 2 ELSE salary END AS value_num, CASE ck % 3 WHEN 2 THEN 'CROSS_DOCUMENT_CONFLICT' ELSE 'STRONGER_INDEPENDENT_EVIDENCE' END AS decision FROM seed")
def combine(s: DataFrame) -> DataFrame:
    """Undated values that differ: the one with clearly stronger evidence, else a conflict."""
    first = _item("salary", "CASE ck % 3 WHEN 0 THEN 95e-2 WHEN 1 THEN 5e-1 ELSE 8e-1 END")
    second = _item("salary * 2", "CASE ck % 3 WHEN 0 THEN 5e-1 WHEN 1 THEN 95e-2 ELSE 8e-1 END")
    none = F.lit(None).cast(reconcile.ITEM)
    pairs = s.select("doc_id", first.alias("first"), second.alias("second"), none.alias("first_period"), none.alias("second_period"), F.lit(2.0).alias("absolute"), F.lit(0.025).alias("relative"))
    return reconcile.combine(pairs).select("doc_id", "value_num", "decision")


@query("SELECT doc_id, floor((8e-1 + CASE WHEN ck % 2 = 0 THEN 25e-3 ELSE -25e-3 END - CASE WHEN ck % 3 = 0 THEN 4e-2 ELSE 0 END + CASE WHEN ck % 5 = 0 THEN 35e-3 ELSE 0 END) * 1e6 + 5e-1) / 1e6 AS strength FROM seed")
def evidence_strength(s: DataFrame) -> DataFrame:
    item = _item("1e0", "8e-1", "CASE WHEN ck % 2 = 0 THEN 'direct' ELSE 'derived' END", recurring="ck % 5 = 0", method="CASE WHEN ck % 3 = 0 THEN 'ocr' ELSE 'pdf-text' END")
    return s.select("doc_id", cents(reconcile.evidence_strength(item), 6).alias("strength"))


@query("SELECT doc_id, CASE WHEN ck % 3 = 0 THEN lpad('' || month, 2, '0') || '/' || year WHEN ck % 3 = 1 THEN '01/2020' END AS value, CASE WHEN ck % 3 = 0 THEN year * 12 + month WHEN ck % 3 = 1 THEN 2020 * 12 + 1 ELSE 0 END AS key, ck % 3 < 2 AS reliable FROM seed")
def period_of(s: DataFrame) -> DataFrame:
    own = _item("1e0", "9e-1", date="CASE WHEN ck % 3 = 0 THEN concat(lpad(month, 2, '0'), '/', year) END")
    other = F.when(F.col("ck") % 3 == 1, F.expr("named_struct('value_num', NULL, 'value_str', '01/2020', 'origin', 'direct', 'confidence', 97e-2, 'confirm', false, 'source_date', NULL, 'salary_month', NULL, 'date_confidence', NULL, 'recurring', false, 'method', 'x')").cast(reconcile.ITEM))
    sure = own.withField("date_confidence", F.when(F.col("ck") % 3 == 0, 0.9)).cast(reconcile.ITEM)
    p = reconcile.period_of(sure, other)
    return s.select("doc_id", p["value"].alias("value"), p["key"].alias("key"), p["reliable"].alias("reliable"))


# ---------------------------------------------------------------- provenance and files


@query("SELECT doc_id, CASE ck % 3 WHEN 0 THEN true ELSE false END AS requires_confirmation, CASE WHEN ck % 3 = 2 THEN NULL ELSE 85e-2 + (ck % 3) / 10e0 END AS confidence FROM seed")
def envelope(s: DataFrame) -> DataFrame:
    sure = F.expr("CASE WHEN ck % 3 = 2 THEN NULL ELSE 85e-2 + (ck % 3) / 10e0 END")
    e = provenance.envelope(F.col("salary"), F.lit(None).cast("string"), F.lit("payslip"), sure)
    return s.select("doc_id", e.alias("e")).select("doc_id", "e.requires_confirmation", "e.confidence")


@query("SELECT doc_id, true AS confirmed_by_user, false AS requires_confirmation, salary AS value_num, 'payslip' AS source FROM seed")
def confirm_provenance(s: DataFrame) -> DataFrame:
    e = provenance.envelope(F.col("salary"), F.lit(None).cast("string"), F.lit("payslip"), F.lit(0.5))
    out = s.select("doc_id", provenance.confirmed(e, F.lit("2026-01-01").cast("timestamp")).alias("e"))
    return out.select("doc_id", "e.confirmed_by_user", "e.requires_confirmation", "e.value_num", "e.source")


@query("SELECT doc_id, true AS confirmed_by_user, salary + 1 AS value_num, 'user' AS source FROM seed")
def set_source(s: DataFrame) -> DataFrame:
    e = provenance.envelope(F.col("salary"), F.lit(None).cast("string"), F.lit("payslip"), F.lit(0.5))
    out = s.select("doc_id", provenance.set_by(e, "user", F.col("salary") + 1, True).alias("e"))
    return out.select("doc_id", "e.confirmed_by_user", "e.value_num", "e.source")


@query("""SELECT doc_id, unnest(['grossSalary', 'insuredSalary', 'employeeContributionAmount', 'employeeContributionRate', 'employerContributionAmount', 'employerContributionRate', 'severanceContributionAmount', 'severanceRate', 'payslipMonth']) AS name, 'payslip' AS source, NULL AS value, false AS confirm FROM seed WHERE ck % 2 = 0
 UNION ALL SELECT doc_id, unnest(['currentBalance', 'balanceDate', 'depositManagementFeeRate', 'balanceManagementFeeRate', 'pensionProvider', 'reportDate', 'latestReportedPensionableSalary', 'latestEmployeeContributionAmount', 'latestEmployerContributionAmount', 'latestSeveranceContributionAmount', 'latestEmployeeContributionRate', 'latestEmployerContributionRate', 'latestSeveranceRate']), 'pensionReport', NULL, false FROM seed WHERE ck % 2 = 1""")
def empty_extraction(s: DataFrame) -> DataFrame:
    """All fields of each document's kind, without a value: even customers have payslips, odd ones reports."""
    out = provenance.empty(s.filter("ck % 2 = 0").select("doc_id"), "payslip").unionByName(provenance.empty(s.filter("ck % 2 = 1").select("doc_id"), "pensionReport"))
    return out.select("doc_id", "name", "field.source", F.coalesce(F.col("field.value_num").cast("string"), "field.value_str").alias("value"), F.col("field.requires_confirmation").alias("confirm"))


def _extracted(s: DataFrame) -> DataFrame:
    row = lambda name, origin: F.struct(F.lit(name).alias("name"), F.lit(origin).alias("origin"))
    some = F.explode(F.filter(F.array(row("insuredSalary", "direct"), row("severanceRate", "derived"), row("secret", "direct")), lambda x: (F.col("ck") % 2 == 0) | (x["name"] == "secret")))
    out = s.select("doc_id", "salary", some.alias("x"))
    return out.select("doc_id", "x.name", F.col("salary").alias("value_num"), F.lit(None).cast("string").alias("value_str"), "x.origin", F.lit(0.95).alias("confidence"), F.lit("ILS").alias("unit"), F.lit(False).alias("confirm"), F.lit(None).cast("string").alias("source_date"), F.lit("pdf-text").alias("method"))


@query("SELECT doc_id, unnest(['insuredSalary', 'severanceRate']) AS name, unnest(['payslip', 'payslipDerived']) AS source, salary AS value_num FROM seed WHERE ck % 2 = 0")
def wrap_fields(s: DataFrame) -> DataFrame:
    out = provenance.wrap(s.select("doc_id"), _extracted(s), "payslip").filter("field.value_num is not null")
    return out.select("doc_id", "name", "field.source", "field.value_num")


@query("SELECT doc_id, CAST(CASE WHEN ck % 2 = 0 THEN 2 ELSE 0 END AS BIGINT) AS identified, CASE WHEN ck % 2 = 0 THEN 'partial' ELSE 'manual-required' END AS status FROM seed")
def identified_count(s: DataFrame) -> DataFrame:
    return provenance.identified_count(provenance.wrap(s.select("doc_id"), _extracted(s), "payslip"))


@query("SELECT doc_id, CAST(CASE WHEN ck % 2 = 0 THEN 3 ELSE 1 END AS INT) AS documents, CAST(CASE WHEN ck % 2 = 0 THEN 1 ELSE 3 END AS INT) AS system FROM seed")
def provenance_counts(s: DataFrame) -> DataFrame:
    sources = F.expr("CASE WHEN ck % 2 = 0 THEN array('payslip', 'crossValidated', 'pensionReportDerived', 'user', NULL) ELSE array('payslip', 'system', NULL, 'system', 'user') END")
    documents, system = provenance.counts(sources)
    return s.select("doc_id", documents.alias("documents"), system.alias("system"))


@query("SELECT doc_id, ck % 4 = 0 AS useful, CASE ck % 4 WHEN 0 THEN 'native-text-usable' WHEN 1 THEN 'too-little-text' WHEN 2 THEN 'too-few-digits' ELSE 'no-payslip-anchors' END AS reason FROM seed")
def assess_native_text(s: DataFrame) -> DataFrame:
    line = F.expr("CASE ck % 4 WHEN 0 THEN concat('Insured salary of this month is ', salary, ' shekels') WHEN 1 THEN concat('salary ', ck % 9) WHEN 2 THEN 'Insured salary of this month is not known to us' ELSE 'Some other words of a document from 2026, nothing more' END")
    out = s.select("doc_id", provenance.assess_text(line, "payslip").alias("a"))
    return out.select("doc_id", "a.useful", "a.reason")


@query("SELECT doc_id, ck % 4 = 1 OR ck % 4 = 2 AS wrong FROM seed")
def wrong_document(s: DataFrame) -> DataFrame:
    line = F.expr("CASE ck % 4 WHEN 0 THEN 'Gross \u202fsalary' WHEN 1 THEN 'annual\u00a0report' WHEN 2 THEN 'תגמולי\u2009עובד' ELSE 'gross salary, balance fee' END")
    kind = F.expr("CASE WHEN ck % 4 = 2 THEN 'pensionReport' ELSE 'payslip' END")
    return s.select("doc_id", files.wrong_document(line, kind).alias("wrong"))


@query("SELECT doc_id, CASE ck % 4 WHEN 0 THEN 'cancelled' WHEN 1 THEN 'password-protected' WHEN 2 THEN 'corrupted-pdf' ELSE 'unreadable-pdf' END AS status FROM seed")
def classify_error(s: DataFrame) -> DataFrame:
    name = F.expr("CASE ck % 4 WHEN 0 THEN 'AbortError' WHEN 2 THEN 'InvalidPDFException' END")
    message = F.expr("CASE WHEN ck % 4 = 1 THEN 'No Password given' ELSE 'failed' END")
    return s.select("doc_id", files.error_status(name, message).alias("status"))


@query("SELECT doc_id, CASE ck % 8 WHEN 0 THEN 'unsupported-type' WHEN 1 THEN 'file-too-large' WHEN 2 THEN 'manual-required' WHEN 3 THEN 'corrupted-pdf' WHEN 4 THEN 'password-protected' WHEN 5 THEN 'unknown-kind' WHEN 6 THEN 'unsupported-type' END AS status FROM seed")
def src_file_gate(s: DataFrame) -> DataFrame:
    out = s.select(
        "doc_id",
        F.expr("CASE WHEN ck % 8 IN (1, 3, 7) THEN 'a.PDF' ELSE 'a.txt' END").alias("name"),
        F.expr("CASE ck % 8 WHEN 2 THEN 'image/PNG' WHEN 4 THEN 'application/pdf' WHEN 5 THEN 'application/pdf' WHEN 6 THEN 'image/jpeg' ELSE '' END").alias("mime"),
        F.expr("CASE WHEN ck % 8 = 1 THEN 12582913 ELSE 100 END").alias("size"),
        F.expr("CASE ck % 8 WHEN 3 THEN 'nothing' WHEN 4 THEN '%PDF /Encrypt 1' ELSE '%PDF-1.7' END").cast("binary").alias("content"),
        F.expr("CASE ck % 8 WHEN 2 THEN 'pensionReport' WHEN 5 THEN 'other' ELSE 'payslip' END").alias("kind"),
    )
    return out.select("doc_id", files.gate().alias("status"))


@query("SELECT doc_id, 'Sum (' || ck || ')' || chr(10) || 'of ' || c_mktsegment AS text FROM seed".replace("'Sum (' || ck || ')'", "'Sum ' || ck || ' x'"))
def src_pdf_literal(s: DataFrame) -> DataFrame:
    raw = F.concat(F.lit("%PDF BT (Sum  "), F.col("ck"), F.lit(" x) Tj (y) Tj (of "), F.col("c_mktsegment"), F.lit(")  Tj ET (lost) TJ")).cast("binary")
    return s.select("doc_id", files.literal_text(raw).alias("text"))


@query("SELECT doc_id, CASE ck % 3 WHEN 0 THEN salary WHEN 1 THEN 5e0 ELSE 5e0 END AS salary, CASE ck % 3 WHEN 0 THEN c_name ELSE 'default' END AS name FROM seed")
def src_state_load(s: DataFrame) -> DataFrame:
    """Documents that were saved, one that is broken, and one that is missing."""
    raw = F.when(F.col("ck") % 3 == 0, store.save(F.struct("salary", F.col("c_name").alias("name")))).when(F.col("ck") % 3 == 1, "{broken")
    default = F.struct(F.lit(5.0).alias("salary"), F.lit("default").alias("name"))
    out = s.select("doc_id", store.load(raw, "salary double, name string", default).alias("d"))
    return out.select("doc_id", "d.salary", "d.name")


@query("SELECT owner, name, CAST(age AS INT) AS age FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY saved_at DESC, ck DESC) AS age FROM (SELECT ck, ck % 4 AS owner, trim(c_name) AS name, ck % 50 AS saved_at FROM seed WHERE ck % 9 <> 0)) WHERE age <= 30")
def snk_scenario_ring(s: DataFrame) -> DataFrame:
    saved = s.select((F.col("ck") % 4).alias("owner"), F.when(F.col("ck") % 9 != 0, F.concat(F.lit(" "), "c_name")).otherwise("  ").alias("name"), (F.col("ck") % 50).alias("saved_at"), F.col("ck").alias("saved_order"))
    return store.ring(saved, place="age").select("owner", "name", "age")


@query("SELECT doc_id, 'A' || ck || ',תרחיש 2' AS names FROM seed")
def src_scenario_hydrate_list(s: DataFrame) -> DataFrame:
    raw = F.expr("array(named_struct('name', concat('A', ck), 'usable', true), named_struct('name', 'gone', 'usable', false), named_struct('name', '', 'usable', true))")
    return s.select("doc_id", F.array_join(store.loaded_names(raw), ",").alias("names"))


def snk_event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event under a name by its id, every 12th under one that isn't in the default list."""
    names = F.array(*map(F.lit, (*store.EVENTS, "salary_entered")))
    events = ready(spark).read.parquet(f"{sf_dir}/events.parquet").withColumn("event_type", F.element_at(names, (F.col("event_id") % 12 + 1).cast("int")))
    return store.logged(events).groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


QUERIES["snk_event_log"] = snk_event_log
ORACLES["snk_event_log"] = """SELECT ['app_opened', 'flow_started', 'document_selected', 'document_read_locally', 'manual_flow_selected', 'review_completed', 'forecast_generated', 'improve_forecast_opened', 'comparison_opened',
 'advanced_assumptions_opened', 'retirement_age_changed'][event_id % 12 + 1] AS event_type, count(*) AS n, min(event_id) AS first_id FROM events WHERE event_id % 12 < 11 GROUP BY 1"""


@query("SELECT '' || doc_id AS doc_id, CASE WHEN ck % 2 = 0 THEN 1 ELSE 2 END AS page FROM seed")
def first_sufficient_page(s: DataFrame) -> DataFrame:
    """A salary on the first page, and a contribution there or on the second."""
    row = lambda o, page, y, t: F.struct(F.lit(o).alias("ord"), page.alias("page"), F.lit(float(y)).alias("y"), t.alias("text"))
    words = F.array(row(0, F.lit(1), 0, F.concat(F.lit("Insured salary "), comma(F.col("salary")))), row(1, F.when(F.col("ck") % 2 == 0, 1).otherwise(2), 300, F.concat(F.lit("Employee contribution "), comma(F.col("salary") * 0.07))))
    found = s.select("doc_id", F.explode(words).alias("t")).select("doc_id", "t.*", F.lit(0.0).alias("x"), F.lit(200.0).alias("width"), F.lit(14.0).alias("height"), F.lit(0.9).alias("confidence"))
    return pages.first_sufficient_page(found)


# ---------------------------------------------------------------- from files to fields


def _files(s: DataFrame) -> DataFrame:
    """Eight kinds of files by customer: no PDF, too many pages, the other kind of document, a report, a payslip, a scanned payslip, an empty long scan, a damaged file."""
    case = F.col("ck") % 8
    words = lambda text, y: F.format_string('{"text":"%s","bbox":{"x0":0,"y0":%s,"x1":400,"y1":%s},"confidence":90}', text, F.lit(str(y)), F.lit(str(y + 12)))
    page = lambda n, *lines: F.concat(F.lit(f'{{"page_number":{n},"blocks":[{{"paragraphs":[{{"lines":[{{"words":['), F.concat_ws(",", *[words(t, 100 * i) for i, t in enumerate(lines)]), F.lit("]}]}]}]}"))
    first = page(1, F.concat(F.lit("Insured salary "), comma(F.col("salary"))), F.lit("-"))
    second = page(2, F.concat(F.lit("Employee contribution "), comma(F.col("salary") * 0.07)), F.lit("-"))
    third = page(3, F.concat(F.lit("Severance "), comma(F.col("salary") * 0.0833)))
    scan = extraction.recorded_pages(F.when(case == 5, F.concat(F.lit("["), F.concat_ws(",", first, second, third), F.lit("]"))))
    text = F.when(case.isin(2, 3), report_text()).when(case.isin(1, 4, 7), payslip_text()).otherwise("")
    return spread(s).select(
        "doc_id",
        F.when(case == 0, "a.doc").otherwise("a.pdf").alias("name"),
        F.lit("").alias("mime"),
        F.lit(100).alias("size"),
        F.when(case == 7, "none").otherwise("%PDF-1.7").cast("binary").alias("content"),
        F.when(case == 3, "pensionReport").otherwise("payslip").alias("kind"),
        F.when(case == 1, 11).when(case == 6, 4).otherwise(3).alias("page_count"),
        text.alias("text"),
        F.lit(None).cast(extraction.PAGES).alias("pages"),
        scan.alias("ocr_pages"),
    )


@query("""SELECT doc_id, CASE ck % 8 WHEN 0 THEN 'unsupported-type' WHEN 1 THEN 'too-many-pages' WHEN 2 THEN 'wrong-document' WHEN 6 THEN 'page-limit' WHEN 7 THEN 'corrupted-pdf' ELSE 'partial' END AS status,
 CASE ck % 8 WHEN 1 THEN 'page-count-limit' WHEN 2 THEN 'document-signals-mismatch' WHEN 3 THEN 'native-text-usable' WHEN 4 THEN 'native-text-usable' WHEN 5 THEN 'too-little-text' WHEN 6 THEN 'too-little-text' END AS reason,
 CASE WHEN ck % 8 IN (2, 3, 4) THEN 'pdf-text' WHEN ck % 8 IN (5, 6) THEN 'ocr' END AS method, CAST(CASE ck % 8 WHEN 3 THEN 13 WHEN 4 THEN 9 WHEN 5 THEN 3 ELSE 0 END AS BIGINT) AS identified, CASE WHEN ck % 8 = 3 THEN 'ANNUAL_PENSION_REPORT' END AS classification FROM seed""")
def extract_documents(s: DataFrame) -> DataFrame:
    """The scanned payslip is read up to its second page, where a salary and a contribution are known."""
    return extraction.extract(_files(s))[0].drop("kind")


@query(f"SELECT doc_id, name, {r2('v')} AS value_num, source, {r2('c', 6)} AS confidence, true AS confirm FROM (SELECT doc_id, unnest(['insuredSalary', 'employeeContributionAmount', 'employeeContributionRate']) AS name, unnest([salary, salary * 7e-2, 7e-2]) AS v, unnest(['payslip', 'payslip', 'payslipDerived']) AS source, unnest([s, s, s - 3e-2]) AS c FROM (SELECT *, (9e-1 * 35e-2 + 9e-1 * 25e-2 + 72e-2 * 25e-2 + 96e-2 * 15e-2) * 94e-2 AS s FROM seed WHERE ck % 8 = 5))")
def parse_payslip_ocr(s: DataFrame) -> DataFrame:
    """Recognised fields: confidence is lowered, and all have to be confirmed."""
    fields = extraction.extract(_files(s))[1].filter("field.extraction_method = 'ocr'").filter("field.value_num is not null")
    return fields.select("doc_id", "name", cents(F.col("field.value_num")).alias("value_num"), "field.source", cents(F.col("field.confidence"), 6).alias("confidence"), F.col("field.requires_confirmation").alias("confirm"))


@query("SELECT doc_id, name, stream, CAST(floor(v * 1e2 + 5e-1) / 1e2 AS DOUBLE) AS value_num FROM (SELECT doc_id, unnest(['insuredSalary', 'employeeContributionAmount', 'employeeContributionRate']) AS name, unnest([salary, salary * 7e-2, 7e-2]) AS v, CASE WHEN ck % 2 = 0 THEN 'tokens' ELSE 'flattened-text-fallback' END AS stream FROM seed)")
def parse_with_fallback(s: DataFrame) -> DataFrame:
    """Documents whose tokens hold no contribution, but whose plain text does, are read from the text."""
    pay = F.concat(F.lit("Insured salary "), comma(F.col("salary")))
    whole = F.concat(pay, F.lit("\n-\n-\n-\n-\nEmployee contribution "), comma(F.col("salary") * 0.07))
    found = tokens.of_document(s.select("doc_id", F.when(F.col("ck") % 2 == 0, whole).otherwise(pay).alias("text")))
    return payslip.parse_with_fallback(found, s.select("doc_id", whole.alias("text"))).select("doc_id", "name", "stream", cents(F.col("value_num")).alias("value_num"))


@query(f"SELECT doc_id, field, kind, CAST(rank AS INT) AS rank, {r2('v')} AS value_num, {r2('c', 6)} AS confidence FROM (SELECT doc_id, 'employeeContribution' AS field, unnest(['amount', 'rate', 'rate']) AS kind, unnest([1, 1, 2]) AS rank, unnest([salary * 7e-2, 7e-2, 12e-2]) AS v, unnest([9e-1 * 35e-2 + 9e-1 * 25e-2 + (92e-2 - 300 / 900e0) * 25e-2 + 96e-2 * 15e-2, 9e-1 * 35e-2 + 9e-1 * 25e-2 + 55e-2 * 25e-2 + 96e-2 * 15e-2, 9e-1 * 35e-2 + 9e-1 * 25e-2 + 72e-2 * 25e-2 + 96e-2 * 15e-2 - 30 / 260e0]) AS c FROM seed)")
def label_values(s: DataFrame) -> DataFrame:
    """All values around a label: two in its row, and one 30 units below, less sure for that."""
    out = layout.label_values(layout.build_rows(_labelled(s)))
    return out.select("doc_id", "field", "kind", F.col("rank").cast("int").alias("rank"), cents(F.col("value")).alias("value_num"), cents(F.col("value_confidence"), 6).alias("confidence"))


@query("SELECT doc_id, CASE WHEN ck % 3 = 2 THEN 'PERIODIC_PENSION_REPORT' ELSE 'ANNUAL_PENSION_REPORT' END AS classification FROM seed")
def classification(s: DataFrame) -> DataFrame:
    line = F.expr("CASE ck % 3 WHEN 0 THEN 'The ANNUAL  Report' WHEN 1 THEN 'דוח\u00a0שנתי לעמית' ELSE concat('Quarterly report ', ck) END")
    return s.select("doc_id", report.classification(line).alias("classification"))


@query("SELECT doc_id, '05/2020' AS value, 1e-1 * floor(33e0) AS score, true AS positive FROM seed WHERE ck % 2 = 0 UNION ALL SELECT doc_id, '05/2020', 2e-1, false FROM seed WHERE ck % 2 = 1")
def period_group_max(s: DataFrame) -> DataFrame:
    """A month that is named twice counts once, with the better of its places."""
    text = F.when(F.col("ck") % 2 == 0, "05/2020\n-\n-\n-\n-\n-\nPay period 05/2020").otherwise("05/2020\n-\n-\n-\n-\n-\n05/2020")
    out = payslip.period_candidates(settled(layout.build_rows(tokens.of_document(s.select("doc_id", text.alias("text"))))))
    return out.select("doc_id", "value", cents(F.col("score"), 6).alias("score"), "positive")
