"""Plain restatements that the tests compare with."""

_LOWER = {c: c + 32 for c in range(65, 91)}


def lower(text: str) -> str:
    """A-Z to a-z, nothing else."""
    return text.translate(_LOWER)


def table(spark, folder, name, *columns):
    """Rows of a given table as tuples."""
    return [tuple(r) for r in spark.read.parquet(f"{folder}/{name}.parquet")
            .select(*columns).collect()]
