"""Fixed schemas of the input and output tables."""

from __future__ import annotations

from pyspark.sql import types as T

GENOTYPE_CALL = T.StructType(
    [
        T.StructField("sampleId", T.StringType()),
        T.StructField("alleles", T.ArrayType(T.StringType())),
        T.StructField(
            "variant",
            T.StructType(
                [
                    T.StructField("contig", T.StructType([T.StructField("contigName", T.StringType())])),
                    T.StructField("start", T.LongType()),
                    T.StructField("end", T.LongType()),
                    T.StructField("referenceAllele", T.StringType()),
                    T.StructField("alternateAllele", T.StringType()),
                ]
            ),
        ),
    ]
)

VARIANT_CATALOG = T.StructType(
    [
        T.StructField("snpIdx", T.LongType()),
        T.StructField("contig", T.StringType()),
        T.StructField("start", T.LongType()),
        T.StructField("ref", T.StringType()),
        T.StructField("alt", T.StringType()),
        T.StructField("nonmissing", T.LongType()),
        T.StructField("frequency", T.DoubleType()),
        T.StructField("genotype", T.ArrayType(T.StringType())),
    ]
)
