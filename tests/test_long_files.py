"""Order files of a long table."""

import glob
import gzip

from parcelwise.plans import intake
from parcelwise.session import scratch_path

SF = "/root/testdata/sf0.001"


def test_files_of_a_long_table_are_packed_and_written_in_slices(spark, monkeypatch):
    want = sorted(map(tuple, intake.orders_from_csv(spark, SF).collect()))
    monkeypatch.setattr(intake, "SLICE_ROWS", 2_500)
    monkeypatch.setattr(intake, "CSV_ROWS", 700)
    assert sorted(map(tuple, intake.orders_from_csv(spark, SF).collect())) == want
    files = glob.glob(scratch_path(spark, "orders_csv").removeprefix("file:") + "/*.csv*")
    rows = [sum(1 for _ in gzip.open(f, "rt", encoding="ISO-8859-1")) - 1 for f in files]
    assert all(f.endswith(".csv.gz") for f in files) and max(rows) <= 700
    assert sum(rows) == sum(r[2] for r in want)
