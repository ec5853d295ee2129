"""Request identity.

Rows have no position in Spark, so the row index is an explicit column
(``row_idx``) from ingest onward and is carried as the last ``-`` field of a
``custom_id``.  Only that last field is recoverable: model names contain ``-``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _s(c) -> Column:
    c = c if isinstance(c, Column) else F.lit(c)
    return c.cast("string")


def starter_custom_id(run, dataset, lang, model, idx) -> Column:
    """``{run}-{dataset}-{lang}-{model}-{idx}``."""
    return F.concat_ws("-", _s(run), _s(dataset), _s(lang), _s(model), _s(idx))


def turn_custom_id(lang, run, model, turn, idx) -> Column:
    """``{lang}_{run}_{model}_turn-{turn}-{idx}``."""
    return F.concat(_s(lang), F.lit("_"), _s(run), F.lit("_"), _s(model),
                    F.lit("_turn-"), _s(turn), F.lit("-"), _s(idx))


def eval_custom_id(path, idx) -> Column:
    """``{dialogue path}-{idx}``."""
    return F.concat(_s(path), F.lit("-"), _s(idx))


def decode_row_idx(custom_id) -> Column:
    """Row index from the last ``-`` field; NULL (not an error) when malformed."""
    return F.substring_index(_s(custom_id), "-", -1).try_cast("bigint")


def model_short(model) -> Column:
    """Model name after the last ``/``."""
    return F.substring_index(_s(model), "/", -1)
