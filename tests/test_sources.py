"""CSV reading, keyed storage, files for the audit, repeatable landing, and the time cut."""

import datetime as dt
import os
import re

import pytest
from pyspark.sql import functions as F

from caliper.operators import audit as AU
from caliper.operators import splits as SP
from caliper.sources import tables as TB


def write(folder, name, text):
    path = os.path.join(folder, name)
    with open(path, "wb") as f:
        f.write(text if isinstance(text, bytes) else text.encode())
    return path


def test_csv_types_come_from_the_first_lines_and_bad_rows_are_kept(spark, tmp_dir):
    rows = [f"{i},{i / 2},name {i},2024-01-{1 + i % 28:02d}" for i in range(50)]
    rows[30] = "not a number,1.5,x,2024-01-01"
    rows[31] = "1,2.5,too,2024-01-01,many,fields"
    rows[32] = "1,2.5"
    rows[33] = "99999999999,2.5,large,2024-01-01"
    path = write(tmp_dir, "t.csv", "a,b,c,d\n" + "\n".join(rows) + "\n")
    csv = TB.read_csv(spark, path, sample_lines=10)
    assert csv.dtypes[:4] == [("a", "bigint"), ("b", "double"), ("c", "string"), ("d", "date")]
    told = TB.rejected(csv).first()
    assert (told.rows_read, told.rows_rejected) == (50, 3) and sorted(told.texts) == sorted(rows[30:33])
    mixed = TB.read_table(spark, path)  # the odd value is in the sample: the column is text
    assert mixed.count() == 48 and dict(mixed.dtypes)["a"] == "string"
    good = TB.accepted(csv)
    assert good.count() == 47 and good.columns == ["a", "b", "c", "d"] and good.where("a = 99999999999").count() == 1
    assert good.select("c").count() == 47  # whatever columns a query reads


def test_csv_is_read_by_one_scan(spark, tmp_dir):
    path = write(tmp_dir, "t.csv", "a,b\n1,2\n3,4\n")
    plan = TB.read_table(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan csv") == 1 and "a#" in plan


def test_keyed_storage_spares_the_shuffle(spark, tmp_dir):
    fact = spark.range(2000).select((F.col("id") % 300).alias("k"), F.col("id").alias("v"))
    stored = TB.write_keyed(fact, "keyed_fact", "k", 4, os.path.join(tmp_dir, "keyed"))
    child = spark.range(900).select((F.col("id") % 350).alias("k")).groupBy("k").count()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = stored.join(child, "k", "left")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        fact_side = plan[: plan.index("Project") + 1] if False else plan
        scan = fact_side.index("FileScan parquet")
        above = [line for line in fact_side[:scan].splitlines() if "Exchange" in line]
        assert not [x for x in above if fact_side[: fact_side.index(x)].count("FileScan") == 0 and "hashpartitioning(k" in x and "id#" not in x], plan
        grouped = stored.groupBy("k").agg(F.sum("v"))._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in grouped and "Exchange" in fact.groupBy("k").agg(F.sum("v"))._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 2000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(10 * 1024 * 1024))
        spark.sql("DROP TABLE IF EXISTS keyed_fact")


def test_files_are_scanned_if_they_are_text(spark, tmp_dir):
    os.makedirs(os.path.join(tmp_dir, "sub"))
    key = "token = 'abcdefgh12345678'"
    write(tmp_dir, "plain.py", f"x = 1\n{key}\n")
    write(os.path.join(tmp_dir, "sub"), "deep.txt", "ünï\r\n\r\n" + key)
    write(tmp_dir, "broken.bin", b"\xff\xfe" + key.encode())
    write(tmp_dir, "huge.txt", "x" * 5000 + "\n" + key)
    write(tmp_dir, "empty.txt", "")

    def found(**named):
        files = TB.read_files(spark, tmp_dir, **named)
        return {os.path.basename(r.path): r.message for r in AU.secret_findings(files).collect()}

    want = {"plain.py": "possible secret-like text at line 2", "deep.txt": "possible secret-like text at line 3"}
    assert found() == want | {"huge.txt": "possible secret-like text at line 2"}
    assert found(max_bytes=4000) == want and found(max_bytes=4000, pattern="*.py") == {"plain.py": want["plain.py"]}
    assert TB.read_files(spark, tmp_dir).where("path like '%empty.txt'").count() == 0


def test_repeated_landings_end_in_one_state(spark, tmp_dir):
    rows = [(i, f"2024-0{1 + i % 3}-1{i % 9}", i % 3) for i in range(60)]
    src = spark.createDataFrame(rows, "id int, date string, part int")
    out, log = os.path.join(tmp_dir, "landed"), os.path.join(tmp_dir, "manifest")

    def state():
        return sorted(map(tuple, spark.read.parquet(out).select("id", "part").collect())), sorted(r.landing for r in spark.read.parquet(log).collect())

    for part in (0, 1, 2):
        TB.land(src.where(F.col("part") == part), out, "date", source=f"s{part}", partition_by=["part"], manifest=log)
    first = state()
    assert len(first[0]) == 60 and len(first[1]) == 3
    again = TB.land(src.where("part = 1"), out, "date", source="s1", partition_by=["part"], manifest=log).first()
    assert state() == first and again.rows == 20
    TB.land(src.where("part = 1 and id < 30"), out, "date", source="s1", partition_by=["part"], manifest=log)
    later = state()  # other rows for a partition: replaced, and one more line in the manifest
    assert len(later[0]) == 50 and len(later[1]) == 4
    times = {r.landing: r.landed_at_utc for r in spark.read.parquet(log).collect()}
    TB.land(src.where("part = 1 and id < 30"), out, "date", source="s1", partition_by=["part"], manifest=log)
    assert state() == later and {r.landing: r.landed_at_utc for r in spark.read.parquet(log).collect()} == times


@pytest.mark.parametrize("step", [1, 7, 1000])
def test_time_cut_with_a_timestamp_for_every_row(spark, step):
    """No broadcast and no window, whether each row has a date of its own or all share one."""
    start = dt.datetime(2024, 1, 1)
    rows = [(i * 37 % 500, start + dt.timedelta(seconds=(i * 91 % 500) // step) if i % 50 else None) for i in range(500)]
    df = spark.createDataFrame(rows, "row_id long, date timestamp").repartition(5)
    out = SP.time_split(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Broadcast|Window|Exchange SinglePartition|Join", plan)
    order = sorted((t, i) for i, t in rows if t)
    cut = int(0.8 * len(order))
    want = {i: "train" if n < cut else "test" for n, (_, i) in enumerate(order)}
    assert {r.row_id: r.side for r in out.collect()} == want
    with pytest.raises(ValueError, match="Not enough valid date"):
        SP.time_split(df.where("date is null or row_id < 3"))
