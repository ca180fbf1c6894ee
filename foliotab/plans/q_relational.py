"""B: filters, predicates, sampling, typing."""

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import relational as R
from .registry import query

ORD = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority"


@query("b01_filter", f"select {ORD} from orders where o_totalprice > 300000 and o_orderstatus = 'F'")
def _(t):
    return t.orders.filter("o_totalprice > 300000 and o_orderstatus = 'F'").select(*ORD.split(", "))


@query("b02_filter_by_ids", f"select {ORD} from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def _(t):
    ids = t.customer.filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return R.filter_by_ids(t.orders, ids, "o_custkey").select(*ORD.split(", "))


@query("b03_apply_filters", "select doc_id, lang, source, n_chars from documents where lang in ('en', 'fr') and source = 'src1'")
def _(t):
    d = t.documents.select("doc_id", "lang", "source", "n_chars")
    return R.apply_filters(d, types=["en", "fr"], level="src1", columns=("lang", "source", "doc_id"))


@query("b04_sample", "select doc_id, lang, n_chars from documents order by md5(concat(cast(doc_id as varchar), ':7')), doc_id limit 100")
def _(t):
    return R.sample_exact(t.documents.select("doc_id", "lang", "n_chars"), 100, 7, "doc_id")


@query("b05_query_text", """
select l_orderkey, l_linenumber, l_quantity from lineitem
where l_orderkey in (select o_orderkey from orders where o_orderpriority = '1-URGENT' and o_totalprice < 50000)""")
def _(t):
    questions, error = R.filter_text(t.orders, "o_orderpriority = '1-URGENT' and o_totalprice < 50000")
    assert error is None
    calls = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity")
    return R.filter_by_ids(calls, questions.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey")


@query("b06_contains_filters", """
select conv_id, turn, role from conversations where contains(text, 'The') and contains(lower(role), 'user')""")
def _(t):
    return R.contains_filters(t.conversations, {"text": "The"}, {"role": "USER"}).select("conv_id", "turn", "role")


@query("b07_search", """
with h as (select doc_id, lang, source from documents where contains(lower(text), 'license') or contains(lower(source), 'license'))
select doc_id, lang, source, greatest((select count(*) from h) - 20, 0) as more from h order by doc_id limit 20""")
def _(t):
    return R.search(t.documents, ["text", "source"], "License", "doc_id").select("doc_id", "lang", "source", "more")


@query("b08_value_columns", "select o_orderkey, o_orderstatus as status, o_totalprice as price from orders")
def _(t):
    wide = t.orders.select(
        "o_orderkey",
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("status_quote"),
        F.col("o_totalprice").alias("price"),
        F.lit("read").alias("price_rationale"),
    )
    return R.value_columns(wide)


@query("b09_sanitize_name", """
select p_partkey, regexp_replace(regexp_replace(regexp_replace('#' || p_name || ' (' || p_brand || ')', '[^A-Za-z0-9_]', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g') as clean
from part""")
def _(t):
    return t.part.select("p_partkey", X.sanitize_name(F.concat(F.lit("#"), "p_name", F.lit(" ("), "p_brand", F.lit(")"))).alias("clean"))


@query("b10_typed", """
select l_orderkey, l_linenumber, case when l_quantity = 25 then null else cast(l_quantity as bigint) end as quantity,
  cast(l_extendedprice as double) as price, case when l_returnflag in ('A', 'N') then l_returnflag end as flag,
  l_linestatus = 'O' as open, cast(l_shipdate as date) as shipped
from lineitem""")
def _(t):
    text = t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        F.when(F.col("l_quantity") == 25, "about 25").otherwise(F.col("l_quantity").cast("string")).alias("quantity"),
        F.col("l_extendedprice").cast("decimal(18,2)").cast("string").alias("price"),
        F.col("l_returnflag").alias("flag"),
        F.when(F.col("l_linestatus") == "O", "yes").otherwise("no").alias("open"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("shipped"),
    )
    fields = {"quantity": "int", "price": "float", "flag": "enum", "open": "bool", "shipped": "date"}
    return R.typed(text, fields, {"flag": ["A", "N"]})


@query("b11_rescale", """
with x as (select o_orderkey, cast(round(o_totalprice) as double) as v, o_orderstatus as s from orders)
select o_orderkey,
  round(cast(case s when 'F' then v / 1000 when 'O' then v else -v / 1000000 end as double), 6) as millions,
  round(cast(case s when 'F' then v * 1000 when 'O' then v * 1000000 else -v end as double), 2) as plain
from x""")
def _(t):
    v = F.round("o_totalprice").cast("bigint").cast("string")
    written = (
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("$"), v, F.lit("K")))
        .when(F.col("o_orderstatus") == "O", F.concat(v, F.lit(" million")))
        .otherwise(F.concat(F.lit("("), v, F.lit(")")))
    )
    return t.orders.select(
        "o_orderkey", F.round(X.rescale(written, "millions"), 6).alias("millions"), F.round(X.rescale(written, "none"), 2).alias("plain")
    )


@query("b12_normalize_percent_date", """
select l_orderkey, l_linenumber, round(l_discount * 100, 4) as percent, round(l_discount, 6) as fraction,
  strftime(l_shipdate, '%d.%m.%Y') as shipped
from lineitem""")
def _(t):
    shown = F.concat(F.round(F.col("l_discount") * 100, 0).cast("int").cast("string"), F.lit("%"))
    date = F.when(F.col("l_linestatus") == "O", F.date_format("l_shipdate", "MM/dd/yyyy")).otherwise(F.date_format("l_shipdate", "yyyy-MM-dd"))
    return t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        F.round(R.normalize_percent(shown, "0_100"), 4).alias("percent"),
        F.round(R.normalize_percent(shown, "0_1"), 6).alias("fraction"),
        R.normalize_date(date, "dd.MM.yyyy").alias("shipped"),
    )


@query("b13_drop_row_if", """
select c_custkey, c_mktsegment, n, spent from (
  select c_custkey, case when c_acctbal < 0 then '' else c_mktsegment end as c_mktsegment,
    cast(count(o_orderkey) as bigint) as n, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as spent
  from customer left join orders on o_custkey = c_custkey group by all)
where c_mktsegment <> '' and not (spent is null and c_mktsegment = 'BUILDING')""")
def _(t):
    per = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("spent")
    )
    c = t.customer.select("c_custkey", F.when(F.col("c_acctbal") < 0, "").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"))
    c = c.join(per, "c_custkey", "left").fillna({"n": 0})
    c = c.withColumn("build", F.when(F.col("c_mktsegment") != "BUILDING", F.lit("y")))
    rules = {
        "primary_keys": ["c_custkey"],
        "requirements": [{"any_of": [{"all_of": ["c_mktsegment", "n"]}]}],
        "drop_row_if": [{"missing_all_of": ["spent", "build"]}, {"missing_any_of": ["c_mktsegment"]}],
    }
    return R.drop_row_if(c, rules).drop("build")


@query("b14_relevant_chunks", """
select doc_id, lang, n_chars from documents where doc_id in (select doc_id from labels where quality = 1)""")
def _(t):
    verdicts = t.labels.select("doc_id", (F.col("quality") == 1).alias("relevant"))
    return R.relevant_chunks(t.documents.select("doc_id", "lang", "n_chars"), verdicts, ["doc_id"])
