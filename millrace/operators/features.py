"""Feature vectors of condition records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def feature_vectors(df: DataFrame, texts: Sequence[str], numbers: Sequence[str], name: str = "features") -> DataFrame:
    """One-hot texts (a value of its own for missing), numbers with medians for missing, standardised, and flags of what was missing."""
    rows = df.withColumns({f"_t_{c}": F.coalesce(F.col(c), F.lit("__missing__")) for c in texts} | {f"_m_{c}": F.col(c).isNull().cast("double") for c in numbers} | {f"_n_{c}": F.col(c).cast("double") for c in numbers})
    steps = [
        StringIndexer(inputCols=[f"_t_{c}" for c in texts], outputCols=[f"_i_{c}" for c in texts], stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCols=[f"_i_{c}" for c in texts], outputCols=[f"_o_{c}" for c in texts], dropLast=False),
        Imputer(inputCols=[f"_n_{c}" for c in numbers], outputCols=[f"_f_{c}" for c in numbers], strategy="median"),
        VectorAssembler(inputCols=[f"_f_{c}" for c in numbers], outputCol="_v"),
        StandardScaler(inputCol="_v", outputCol="_s", withMean=True, withStd=True),
        VectorAssembler(inputCols=[*(f"_o_{c}" for c in texts), "_s", *(f"_m_{c}" for c in numbers)], outputCol=name),
    ]
    return Pipeline(stages=steps).fit(rows).transform(rows).select(*df.columns, name)
