"""Column expressions that normalise identifiers. All stay in the JVM; null in, null out unless stated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Identifier patterns of public registries (first group: the id). Letter case of the prefix is ignored,
# as files spell it in several ways.
PATTERNS = {
    "drugbank": r"\b(DB\d{5,})\b",
    "mondo": r"(?i:MONDO):(\d+)",
    "doid": r"(?i:DOID):(\d+)",
    "ncbigene": r"(?i:NCBIGene):(\d+)",
    "pubchem": r"(?i:PUBCHEM\.COMPOUND):(\d+)",
    "uniprot": r"(?i:UniProtKB):([A-Z0-9\-]+)",
    "reactome": r"(R-HSA-\d+)",
    "mesh": r"(?i:MESH):([CD]\w*)",
}
#: Reactome's pattern for any species.
REACTOME_ANY = r"(R-[A-Z]{3}-\d+)"
# Confidence of a knowledge level; any other level has none.
LEVEL_CONFIDENCE = {"knowledge_assertion": 1.0, "logical_entailment": 0.9, "statistical_association": 0.6, "observation": 0.5, "prediction": 0.3}
# Display words of node types; any other type is itself, in lower case with underscores.
DISPLAY_TYPES = {
    "drug": "drug", "compound": "compound", "small molecule": "compound", "disease": "disease", "phenotypic feature": "phenotype",
    "phenotype": "phenotype", "effect/phenotype": "phenotype", "gene": "gene", "protein": "protein", "gene/protein": "gene/protein",
    "pathway": "pathway", "anatomy": "anatomy", "molecular function": "molecular_function", "biological process": "biological_process",
    "cellular component": "cellular_component", "exposure": "other",
}


def known(column: Column) -> Column:
    """column trimmed; null where nothing is left."""
    return F.nullif(F.trim(column.cast("string")), F.lit(""))


def last_segment(column: Column) -> Column:
    """What follows the last "::"; all of it where there is none."""
    return F.element_at(F.split(column, "::"), -1)


def after_first_segment(column: Column) -> Column:
    """What follows the first "::"; all of it where there is none."""
    return F.regexp_replace(column, r"^.*?::", "")


def type_prefix(column: Column) -> Column:
    """The type before the first "::", "unknown" where there is none."""
    return F.when(column.contains("::"), F.substring_index(column, "::", 1)).when(column.isNotNull(), F.lit("unknown"))


def bare_number(column: Column, prefix: str) -> Column:
    """column without the CURIE prefix and leading zeros; "0" if nothing is left."""
    return F.regexp_replace(F.ltrim(F.regexp_replace(column, f"^{prefix}:?", ""), F.lit("0")), "^$", "0")


def extract(column: Column, kind: str) -> Column:
    """The first id of a registry in column; null if there is none."""
    return F.nullif(F.regexp_extract(column, PATTERNS[kind], 1), F.lit(""))


def curies(column: Column) -> Column:
    """All CURIE tokens of column, in order."""
    return F.regexp_extract_all(column, F.lit(r"([A-Za-z][\w.]*:[\w.\-]+)"), F.lit(1))


def source_tokens(column: Column) -> Column:
    """The source words of a packed field, joined by a vertical bar."""
    return F.array_join(F.regexp_extract_all(column, F.lit(r"([a-zA-Z][\w-]*)"), F.lit(1)), "|")


def level_confidence(column: Column) -> Column:
    return F.create_map(*[x for k, v in LEVEL_CONFIDENCE.items() for x in (F.lit(k), F.lit(v))])[column]


def mixed_number(column: Column) -> Column:
    """"MONDO:0007455", "7455.0" and "7455" all as "7455"; null where no number is meant."""
    return F.regexp_replace(column, "^MONDO:", "").try_cast("double").cast("bigint").cast("string")


def mesh_clean(column: Column) -> Column:
    """A MeSH id without its braced note."""
    return F.trim(F.regexp_replace(column, r"\{.*?\}", ""))


def mesh_head(column: Column) -> Column:
    """A MeSH id up to its first blank."""
    return F.substring_index(column, " ", 1)


def bare_mesh(column: Column) -> Column:
    """Whether column is a MeSH number without its prefix (C or D and digits only)."""
    return column.rlike(r"^[DC]\d+$")


def first_accession(column: Column) -> Column:
    """A protein accession without its isoform suffix."""
    return F.substring_index(column, "-", 1)


def display_type(column: Column) -> Column:
    """The display word of a node type; "other" for null and empty ones."""
    low = F.lower(F.coalesce(column, F.lit("")))
    listed = F.create_map(*[F.lit(x) for kv in DISPLAY_TYPES.items() for x in kv])
    return F.coalesce(listed[low], F.nullif(F.replace(low, F.lit(" "), F.lit("_")), F.lit("")), F.lit("other"))


def looks_opaque(column: Column) -> Column:
    """Whether a name is empty or consists of capitals, digits and id marks only."""
    return F.coalesce(column.rlike(r"^[A-Z0-9:_.\-]*$"), F.lit(True))


def relation_key(column: Column) -> Column:
    """A relation name reduced to its letters."""
    return F.regexp_replace(F.lower(column), "[^a-z]", "")
