"""Scripts over whole groups without a schema."""

import pytest

from brindle.operators import scripts


def gaps():
    """The class travels to the workers by value."""

    class Gaps:
        def __init__(self):
            self.last, self.n = None, 0

        def feed(self, row):
            self.n += 1
            if self.last is not None and row["t"] - self.last > 1:
                yield {"k": row["k"], "t": row["t"], "gap": float(row["t"] - self.last), "n": None}
            self.last = row["t"]

        def finish(self):
            yield {"k": "end", "t": self.last, "gap": 0.0, "n": self.n}

    return Gaps


def test_rows_come_in_order_and_groups_end(spark):
    df = spark.createDataFrame([("a", 5), ("a", 1), ("b", 2), ("a", 2), (None, 9), ("b", 7)], "k string, t int")
    out = scripts.streamed_script(df, gaps(), ["k"], ["t"])
    assert [(f.name, f.dataType.simpleString()) for f in out.schema] == [("k", "string"), ("t", "int"), ("gap", "double"), ("n", "bigint")]
    got = sorted(tuple(r) for r in out.collect())
    assert got == sorted([("a", 5, 3.0, None), ("end", 5, 0.0, 3), ("b", 7, 5.0, None), ("end", 7, 0.0, 2), ("end", 9, 0.0, 1)], key=lambda r: r[:3])
    assert scripts.streamed_script(df.limit(0), gaps(), ["k"], ["t"]).count() == 0


def test_switched_off_and_silent_scripts(spark):
    df = spark.createDataFrame([("a", 5)], "k string, t int")
    with pytest.raises(PermissionError):
        scripts.streamed_script(df, gaps(), ["k"], enabled=False)

    class Silent:
        def feed(self, row):
            return ()

    with pytest.raises(Exception, match="columns"):
        scripts.streamed_script(df, Silent, ["k"]).collect()
