"""Shapes of model server responses, as expressions on their JSON."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schemas


def embedding_of(json: Column) -> Column:
    return F.get(F.from_json(json, schemas.EMBEDDING_RESPONSE).data, F.lit(0)).embedding


def model_ids(json: Column) -> Column:
    return F.transform(F.from_json(json, schemas.MODEL_LIST).data, lambda m: m.id)


def first_model(json: Column) -> Column:
    return F.get(model_ids(json), F.lit(0))


def completion(json: Column) -> tuple[Column, Column]:
    """(content, total_tokens with 0 for none)"""
    c = F.from_json(json, schemas.COMPLETION)
    return F.get(c.choices, F.lit(0)).message.content, F.coalesce(c.usage.total_tokens, F.lit(0))


def connected(json: Column) -> Column:
    """Whether a model server's answer lists models; false for no answer or a broken one."""
    return F.coalesce(F.size(model_ids(json)) > 0, F.lit(False))
