import pytest
from pyspark.sql import functions as F


@pytest.fixture
def frame(spark):
    """A frame of rows with an extra column whose name an operator might use itself."""

    def make(rows, schema, extra=("size", "tile", "cell", "label_", "component", "v", "m")):
        df = spark.createDataFrame(rows, schema)
        names = set(df.columns)
        for name in extra:
            if name not in names:
                df = df.withColumn(name, F.lit("x"))
        return df

    return make
