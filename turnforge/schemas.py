"""Declared schemas (no inference anywhere)."""

from pyspark.sql import types as T

MESSAGE = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])
MESSAGES = T.ArrayType(MESSAGE)

PARAMS = T.StructType([
    T.StructField("temperature", T.DoubleType()),
    T.StructField("top_p", T.DoubleType()),
    T.StructField("frequency_penalty", T.DoubleType()),
    T.StructField("presence_penalty", T.DoubleType()),
    T.StructField("max_tokens", T.IntegerType()),
    T.StructField("response_format", T.StringType()),
])

SCENES = T.StructType([
    T.StructField("scene_id", T.LongType()),
    T.StructField("scene", T.StringType()),
    T.StructField("lang", T.StringType()),
])

REQUESTS = T.StructType([
    T.StructField("custom_id", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("lang", T.StringType()),
    T.StructField("run_id", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("role", T.StringType()),
    T.StructField("turn", T.IntegerType()),
    T.StructField("row_idx", T.LongType()),
    T.StructField("attempt", T.IntegerType()),
    T.StructField("messages", MESSAGES),
    T.StructField("params", PARAMS),
])

COMPLETIONS = T.StructType([
    T.StructField("custom_id", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("attempt", T.IntegerType()),
    T.StructField("content", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("model", T.StringType()),
])

ATTEMPTS = T.StructType([
    T.StructField("custom_id", T.StringType()),
    T.StructField("attempt", T.IntegerType()),
    T.StructField("content", T.StringType()),
    T.StructField("verdict", T.StringType()),
    T.StructField("accepted", T.BooleanType()),
])

DIALOGUES = T.StructType([
    T.StructField("row_idx", T.LongType()),
    T.StructField("source", T.StringType()),
    T.StructField("scene", T.StringType()),
    T.StructField("lang", T.StringType()),
    T.StructField("dialogue", MESSAGES),
    T.StructField("models", T.ArrayType(T.StringType())),
    T.StructField("ended", T.BooleanType()),
])

# Wire format of one completion line (three producers normalised to this).
_CHOICE = T.StructType([T.StructField("message", MESSAGE)])
COMPLETION_WIRE = T.StructType([
    T.StructField("custom_id", T.StringType()),
    T.StructField("response", T.StructType([
        T.StructField("body", T.StructType([
            T.StructField("model", T.StringType()),
            T.StructField("choices", T.ArrayType(_CHOICE)),
        ])),
        T.StructField("prompt", T.StringType()),
    ])),
    T.StructField("_corrupt_record", T.StringType()),
])
# Failure form: the body is a list of error strings.
COMPLETION_ERRORS_WIRE = T.StructType([
    T.StructField("response", T.StructType([T.StructField("body", T.ArrayType(T.StringType()))])),
])

MANIFEST = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("input_file_id_openai", T.StringType()),
    T.StructField("input_file_local", T.StringType()),
    T.StructField("created_at", T.LongType()),
])

LABEL = T.StructType([T.StructField("label", T.IntegerType()), T.StructField("comment", T.StringType())])


def judgement_schema(keys):
    return T.StructType([T.StructField(k, LABEL) for k in keys] + [T.StructField("_corrupt_record", T.StringType())])
