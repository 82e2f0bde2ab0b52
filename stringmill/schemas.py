"""Explicit schemas. No reader or writer in this package infers types."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _I, _D, _B = (
    T.StringType(),
    T.LongType(),
    T.IntegerType(),
    T.DoubleType(),
    T.BooleanType(),
)


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields])


ITEMS = _struct(("item", _S))

# fixed values: column names of the exchanged tables
REACTIONS = _struct(
    ("USPTO-50k_id", _S),
    ("split", _S),
    ("product_smiles", _S),
    ("reaction_smarts_with_atom_mapping", _S),
)
REACTION_RENAMES = {
    "id": "USPTO-50k_id",
    "split": "split",
    "prod_smiles": "product_smiles",
    "reaction_smarts": "reaction_smarts_with_atom_mapping",
}
GENERATED_ITEMS = _struct(
    ("smiles", _S), ("canonical_smiles", _S), ("valid", _B), ("unique", _B), ("novel", _B)
)
GENERATED_TEMPLATES = _struct(
    ("smarts", _S),
    ("valid", _B),
    ("unique", _B),
    ("feasible", _B),
    ("not_trained_on_but_known", _B),
    ("known_from_valid_set", _B),
    ("known_from_test_set", _B),
    ("num_products_works_with", _I),
    ("example_works_with_reaction_id", _S),
)

VOCAB = _struct(("token", _S), ("id", _I))
MERGES = _struct(("rank", _I), ("left", _S), ("right", _S))
UNIGRAM = _struct(("piece", _S), ("logp", _D), ("id", _I))
ENCODED = _struct(
    ("input_ids", T.ArrayType(_I)),
    ("attention_mask", T.ArrayType(_I)),
    ("special_tokens_mask", T.ArrayType(_I)),
)
MOMENTS = _struct(
    ("n", _L), ("mu", T.ArrayType(_D)), ("sigma", T.ArrayType(T.ArrayType(_D)))
)
SAMPLES = _struct(("group", _S), ("value", _D))
RUN_METRICS = _struct(("run", _S), ("metric", _S), ("value", _S))
