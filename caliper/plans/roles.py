"""Role binding of the driver's TPC-H-like tables to the operators' inputs.

The operators are domain-neutral; this module says which table plays which role so
that every registered query reads the given tables (or data Spark derives from them)
and its work grows with them:

* fact (collision)      = ``orders`` (key ``o_orderkey``, date ``o_orderdate``)
* child A (vehicle)     = ``lineitem`` by ``l_orderkey``; ``l_linenumber`` plays the maximum
* child B (casualty)    = all ``lineitem`` rows; without return flag R the key is NULL
* daily weather         = one row per ``lineitem`` ship day; measures over its rows with flag R and
                          discount 0.05, NULL on days without one
* calendar              = three fixed holidays for every year the orders span
* target codes          = first digit of ``o_orderpriority`` (1–3 valid, 4–5 invalid)
* timed events          = ``events.ts`` (time of day for the hour features)
* scored frame          = ``lineitem`` (truth from the return flag, prediction from the line number)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def collision(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(
        F.col("o_orderkey").alias("accident_index"),
        F.substring("o_orderpriority", 1, 1).try_cast("int").alias("accident_severity"),
        F.col("o_orderdate").alias("date"),
        F.when(F.col("o_orderstatus") == "O", F.lit(None)).otherwise(F.col("o_custkey") % 4).alias("number_of_casualties"),
        F.col("o_totalprice").alias("location_easting_osgr"),
        (F.col("o_custkey") * 10).alias("location_northing_osgr"),
        F.col("o_orderstatus").alias("order_status"),
        time_of_day().alias("time"),
    )


def time_of_day():
    """Clock text derived from the keys: unpadded hour, padded minute; medium-priority
    orders carry a seconds part, which the hour parser must reject (hour -> 12)."""
    hm = F.concat((F.col("o_custkey") % 24).cast("string"), F.lit(":"),
                  F.lpad((F.col("o_orderkey") % 60).cast("string"), 2, "0"))
    return F.when(F.col("o_orderpriority").startswith("3"), F.concat(hm, F.lit(":00"))).otherwise(hm)


def vehicle(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("accident_index"), F.col("l_linenumber").alias("number_of_vehicles"))


def casualty(spark: SparkSession, d: str) -> DataFrame:
    """All lineitem rows; those without return flag R have a NULL key (a hot key)."""
    li = table(spark, d, "lineitem")
    return li.select(F.when(F.col("l_returnflag") == "R", F.col("l_orderkey")).alias("accident_index"))


def weather(spark: SparkSession, d: str) -> DataFrame:
    """One row per ship day over all lineitem rows; measures are taken from the rows with
    flag R and discount 0.05, so days without such a row have NULL measures."""
    li = table(spark, d, "lineitem")
    seen = (F.col("l_returnflag") == "R") & (F.col("l_discount") == F.lit(0.05))

    def of(c):
        return F.when(seen, F.col(c))

    q = of("l_quantity")
    n = F.count_if(seen)
    return (li.groupBy(F.to_date("l_shipdate").alias("date"))
            .agg(F.when(n > 0, (n % 9).cast("double")).alias("cloud_cover"),
                 (F.min(q) / 4).alias("sunshine"),
                 (F.max(of("l_extendedprice")) / 100).alias("global_radiation"),
                 (F.max(q) / 2).alias("max_temp"),
                 (F.avg(q) / 2).alias("mean_temp"),
                 (F.min(q) / 2).alias("min_temp"),
                 (F.max(of("l_tax")) * 10).alias("precipitation"),
                 (F.lit(1000) + F.sum(of("l_linenumber")) % 40).cast("double").alias("pressure"),
                 F.when(F.min(q) > 45, F.lit(1.0)).when(n > 0, F.lit(0.0)).alias("snow_depth")))


# fixed values: holidays placed in every year of the fact table's range (month, day, title)
HOLIDAYS = ((1, 1, "New Year's Day"), (12, 25, "Christmas Day"), (12, 26, "Boxing Day"))


def calendar(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    years = o.agg(F.year(F.min("o_orderdate")).alias("lo"), F.year(F.max("o_orderdate")).alias("hi"))
    days = F.array(*[F.struct(F.make_date(F.col("y"), F.lit(m), F.lit(dd)).alias("date"), F.lit(t).alias("title"))
                     for m, dd, t in HOLIDAYS])
    return (years.select(F.explode(F.sequence("lo", "hi")).alias("y"))
            .select(F.explode(days).alias("h"))
            .select(F.col("h.date").alias("date"), F.lit(1).alias("is_bank_holiday"),
                    F.col("h.title").alias("bank_holiday_title")))


def master(spark: SparkSession, d: str):
    from caliper.plans.master import build_master
    return build_master(collision(spark, d), vehicle(spark, d), casualty(spark, d), weather(spark, d),
                        calendar(spark, d))


# fixed values: feature lists of the binding (numeric first, then categorical)
NUMERIC_FEATURES = ["number_of_vehicles", "hour", "day_of_week", "month", "is_weekend", "season", "cloud_cover",
                    "sunshine", "global_radiation", "max_temp", "mean_temp", "min_temp", "precipitation", "pressure",
                    "snow", "hour_peak", "precipitation_peak_interaction", "low_visibility_proxy"]
CATEGORICAL_FEATURES = ["order_status", "is_bank_holiday"]
FEATURES = NUMERIC_FEATURES + CATEGORICAL_FEATURES
POST_EVENT_FEATURES = ["number_of_vehicles", "number_of_casualties"] + FEATURES[1:]
WEATHER_FEATURES = ["cloud_cover", "sunshine", "global_radiation", "max_temp", "mean_temp", "min_temp",
                    "precipitation", "pressure"]


def prepared(spark: SparkSession, d: str, features=None) -> DataFrame:
    from caliper.operators.prepare import prepare
    m, _ = master(spark, d)
    return prepare(m, features or FEATURES, target="accident_severity", row_id="accident_index")


def timed_events(spark: SparkSession, d: str) -> DataFrame:
    """Events with a date and a clock text; error events carry seconds (rejected -> 12)."""
    e = table(spark, d, "events")
    t = F.when(F.col("event_type") == "error", F.date_format("ts", "HH:mm:ss")).otherwise(F.date_format("ts", "H:mm"))
    return e.select("event_id", F.col("ts").alias("date"), t.alias("time"))


def text_dates(spark: SparkSession, d: str) -> DataFrame:
    """Order dates rendered as text in three formats plus an unparseable form."""
    o = table(spark, d, "orders")
    od = F.col("o_orderdate")
    s = (F.when(F.col("o_orderpriority").startswith("5"), F.lit("not a date"))
         .when(F.col("o_orderstatus") == "F", F.date_format(od, "yyyy-MM-dd"))
         .when(F.col("o_orderstatus") == "O", F.date_format(od, "dd/MM/yyyy"))
         .otherwise(F.date_format(od, "yyyyMMdd")))
    return o.select(F.col("o_orderkey").alias("accident_index"), s.alias("date_text"))


# fixed values: class labels of the scored binding (index 0 is the critical class)
CLASS_LABELS = ["Fatal", "Serious", "Slight"]
CRITICAL = 0


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Scored frame: truth from the return flag (A/N/R -> 0/1/2), prediction from the
    line number, critical-class score from the quantity (many ties)."""
    li = table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
                     F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
                     .alias("label"),
                     (F.col("l_linenumber") % 3).alias("prediction"),
                     (F.col("l_quantity") / 50).alias("score"))


# fixed values: three scored "models" over the same rows (name, training order)
MODELS = (("forest", 0), ("boosting", 1), ("logistic", 2))


def scored_models(spark: SparkSession, d: str) -> DataFrame:
    """Three model outputs per lineitem row in one scan (a generator, not a union)."""
    li = table(spark, d, "lineitem")
    preds = [(F.col("l_linenumber") % 3).cast("int"), (F.col("l_partkey") % 3).cast("int"),
             ((F.col("l_suppkey") + F.col("l_linenumber")) % 3).cast("int")]
    scores = [F.col("l_quantity") / 50, F.col("l_discount") * 10, F.col("l_tax") * 12.5]
    arr = F.array(*[F.struct(F.lit(n).alias("model_name"), F.lit(o).alias("train_order"), p.alias("prediction"),
                             s.alias("score")) for (n, o), p, s in zip(MODELS, preds, scores)])
    y = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return li.select(y.alias("label"), F.explode(arr).alias("m")).select("label", "m.*")


def prepared_checkpointed(spark: SparkSession, d: str, features=None) -> DataFrame:
    """The prepared frame written once to the shared checkpoint folder: operators that
    read it several times (splits, folds, reports) then scan the checkpoint instead of
    re-running the enrichment plan, and a lost executor recomputes from it."""
    from caliper.session import cut_lineage
    return cut_lineage(prepared(spark, d, features))


def documents_as_files(spark: SparkSession, d: str) -> DataFrame:
    """Documents as audit inputs: path = ``doc/<doc_id>``, size = UTF-8 bytes, text."""
    docs = table(spark, d, "documents")
    return docs.select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"),
                       F.octet_length("text").cast("bigint").alias("size"), "text", "source")


def page_paths(spark: SparkSession, d: str) -> DataFrame:
    """A file path for each page: the URL's path, and for 15 of 16 page ids a form that
    one of the path rules, or an exception to one, is about."""
    pages = table(spark, d, "pages")
    base = F.regexp_extract("url", r"^[a-z]+://[^/]+/?([^?#]*)", 1)
    page = F.col("page_id").cast("string")
    # fixed values: forms by page id modulo 16
    forms = [F.lit("artifacts/model.joblib"), F.lit("artifacts/error_cases.csv"), F.lit("data/sample/merged_sample.csv"),
             F.concat(F.lit("keys/"), base, F.lit(".PEM")), F.concat(base, F.lit("/.env.local")),
             F.concat(F.lit("data/raw/"), base), F.lit("data/raw/.gitkeep"), F.concat(F.lit("data/sample/"), base),
             F.concat(F.lit("artifacts/"), base, F.lit(".pkl")), F.concat(F.lit("p"), page, F.lit(".zip")),
             F.concat(F.lit("p"), page, F.lit(".pdf")), F.concat(F.lit("practical"), page, F.lit(".ipynb")),
             F.lit("docs/practical.ipynb"), F.concat(base, F.lit("/biplot_2d.png")), F.lit("data/processed/x.key"), base]
    path = F.coalesce(*[F.when(F.col("page_id") % 16 == i, f) for i, f in enumerate(forms)])
    return pages.select(path.alias("path"))
