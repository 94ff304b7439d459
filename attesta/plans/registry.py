"""Fixed registries: the extractor profile, which symbols an occurrence may name, and the inventory's rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Profile:
    identity: str
    languages: tuple[str, ...]
    skipped_dirs: tuple[str, ...]
    candidate_cap: int | None


_PROFILES = {"V9": Profile("attesta-profile-9", ("python", "rust"), ("target", "node_modules", "__pycache__", "venv", "site-packages", "build", "dist"), 8)}


def profile(name: str) -> Profile:
    """A frozen profile; an unknown one is refused."""
    if name not in _PROFILES:
        raise ValueError(f"unknown profile {name}")
    return _PROFILES[name]


#: Symbol kinds that each kind of occurrence may name.
CANDIDATE_KINDS = {
    "python": {
        "type_reference": ["class"], "base_class": ["class"], "declared_return": ["class"], "receiver_type": ["class"],
        "call_observed": ["function", "class"], "method_call_observed": ["method", "function", "class"], "name_reference": ["variable", "function", "class"],
        "attribute_access": ["field"], "keyword_argument": ["field"],
    },
    "rust": {
        "type_reference": ["struct", "enum", "union", "trait", "type"], "declared_return": ["struct", "enum", "union", "trait", "type"], "struct_literal": ["struct", "variant"],
        "call_observed": ["function", "method", "trait_method", "struct", "variant"], "method_call_observed": ["method", "trait_method"],
        "field_init": ["field"], "field_assign": ["field"], "attribute_access": ["field"], "name_reference": ["const", "static", "function", "variant", "struct"],
    },
}


def candidate_kinds(spark: SparkSession) -> DataFrame:
    rows = [(language, occ, sym) for language, kinds in CANDIDATE_KINDS.items() for occ, syms in kinds.items() for sym in syms]
    return spark.sql("SELECT * FROM VALUES " + ", ".join(map(str, rows)) + " AS t(language, occ_kind, sym_kind)")


#: Rules of the inventory: (id, operation, language or None, matcher, names, receivers).
RULES = [
    ("collect", "allocation", "rust", "call", ["collect", "to_vec", "clone", "to_owned", "to_string"], []),
    ("sort", "sort", None, "call", ["sort", "sorted", "sort_by", "sort_unstable"], []),
    ("io-read", "io", "python", "call", ["open", "read", "readlines"], []),
    ("io-rust", "io", "rust", "call", ["read_to_string", "open", "write_all"], ["fs", "File"]),
    ("regex", "regex", "python", "call", ["compile", "match", "search", "findall"], ["re"]),
    ("math", "math", None, "call", ["sqrt", "sin", "cos", "pow", "abs"], []),
    ("lock", "lock", "rust", "call", ["lock", "read", "write"], []),
    ("membership", "list_membership", "python", "list_membership", [], []),
    ("module-write", "module_write", "python", "module_write", [], []),
    ("lock-field", "lock", None, "field_declared_with", ["Mutex", "RwLock", "Lock"], []),
]
