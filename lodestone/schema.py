"""Schemas of the catalog's tables and of the frames that operators exchange."""

from __future__ import annotations

from pyspark.sql import types as T

TEXT_DIM, LOGO_DIM = 384, 512

MARKS = T.StructType(
    [T.StructField("id", T.LongType(), False), T.StructField("serial_number", T.StringType(), False)]
    + [T.StructField(c, T.StringType()) for c in ("int_reg_number", "class_indices", "registration_date", "trademark_name", "description", "disclaimer", "applicant_name", "applicant_address", "agent_details")]
    + [T.StructField(c, T.BinaryType()) for c in ("logo_data", "evidence_snapshot")]
    + [T.StructField(c, T.ArrayType(T.FloatType())) for c in ("text_embedding", "logo_embedding")]
    + [T.StructField(c, T.StringType()) for c in ("batch_number", "batch_year", "category")]
    + [T.StructField("is_split", T.BooleanType()), T.StructField("created_at", T.TimestampType())]
)

CLIENTS = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("file_name", T.StringType()),
        T.StructField("logo_data", T.BinaryType()),
        T.StructField("logo_embedding", T.ArrayType(T.FloatType())),
        T.StructField("applicant_name", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("upload_date", T.TimestampNTZType()),
    ]
)

USERS = T.StructType(
    [T.StructField("id", T.LongType(), False)]
    + [T.StructField(c, T.StringType()) for c in ("username", "email", "password_hash", "role")]
    + [T.StructField("is_temporary_password", T.BooleanType()), T.StructField("created_at", T.TimestampType())]
)

WORDS = T.StructType(
    [T.StructField("doc_id", T.StringType()), T.StructField("page", T.IntegerType())]
    + [T.StructField(c, T.DoubleType()) for c in ("page_w", "page_h")]
    + [T.StructField("text", T.StringType())]
    + [T.StructField(c, T.DoubleType()) for c in ("x0", "x1", "top", "bottom")]
)

#: Columns of a mark that an upsert overwrites, and those that keep the value first stored.
OVERWRITTEN = ("class_indices", "trademark_name", "description", "applicant_name", "applicant_address", "agent_details", "logo_data", "evidence_snapshot", "text_embedding", "logo_embedding", "batch_number", "batch_year")
FIRST_STORED = ("int_reg_number", "registration_date", "disclaimer", "category", "is_split", "created_at")
