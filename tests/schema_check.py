"""Compare Spark result types with DuckDB result types for every oracle query."""

import sys

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])

from tests.oracle_check import duck  # noqa: E402

MAP = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE",
       "boolean": "BOOLEAN", "date": "DATE", "smallint": "SMALLINT", "float": "FLOAT",
       "timestamp_ntz": "TIMESTAMP"}


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    from exposa.plans.catalog import ORACLE, QUERIES
    from exposa.session import get_spark
    spark = get_spark()
    con = duck(sf)
    bad = 0
    for name, sql in ORACLE.items():
        s = dict(QUERIES[name](spark, sf).dtypes)
        d = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
        diffs = [(c, s.get(c), d.get(c)) for c in sorted(set(s) | set(d))
                 if MAP.get(s.get(c), s.get(c)) != d.get(c)]
        if diffs:
            bad += 1
            print(name, diffs, flush=True)
    print("queries with type differences:", bad)


if __name__ == "__main__":
    main()
