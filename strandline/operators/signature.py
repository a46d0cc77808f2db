"""Signatures: metadata with a list of sketches, and what is asked of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.sketch import SKETCH, equal, new_sketch

# What a signature says where nothing else is given.
DEFAULTS = {"class": "sourmash_signature", "email": "", "hash_function": "0.murmur64", "license": "CC0", "version": 0.4}
#: The columns of a table of signatures.
SIGNATURE = f"`class` string, email string, hash_function string, filename string, name string, license string, version double, signatures array<{SKETCH}>"
METADATA = ["class", "email", "hash_function", "filename", "name", "license", "version"]


def new_signatures(sketches: DataFrame, name: str = "name", filename: Column | None = None, sketch: str = "sketch") -> DataFrame:
    """A signature of one sketch for each row, named by a column."""
    given = {k: F.lit(v).alias(k) for k, v in DEFAULTS.items()}
    file = (F.lit(None) if filename is None else filename).cast("string").alias("filename")
    return sketches.select(given["class"], given["email"], given["hash_function"], file, F.col(name).cast("string").alias("name"), given["license"], given["version"], F.array(sketch).alias("signatures"))


def flatten(signatures: DataFrame) -> DataFrame:
    """A row for each sketch, with its signature's metadata; signatures without sketches vanish."""
    return signatures.select(*METADATA, F.posexplode("signatures").alias("sketch_no", "sketch"))


def select(signatures: DataFrame, ksize: int = 0, moltype: str | None = None, scaled: int | None = None) -> DataFrame:
    """Flattened sketches of a word size (0: any) and molecule (``dna`` or ``protein`` in any case, None: any;
    another name selects nothing). ``scaled`` is accepted and selects nothing away."""
    flat = flatten(signatures)
    if ksize:
        flat = flat.where(F.col("sketch.ksize") == ksize)
    if moltype is not None:
        wanted = {"dna": False, "protein": True}.get(moltype.lower())
        flat = flat.where(F.lit(False) if wanted is None else F.col("sketch.is_protein") == wanted)
    return flat


def get_name(name: str = "name") -> Column:
    """The name, or the empty string."""
    return F.coalesce(name, F.lit(""))


get_filename = lambda: get_name("filename")


def set_name(signatures: DataFrame, name: Column | str, field: str = "name") -> DataFrame:
    """The signatures under another name; a string is the name itself."""
    return signatures.withColumn(field, (F.lit(name) if isinstance(name, str) else name).cast("string"))


def set_filename(signatures: DataFrame, name: Column | str) -> DataFrame:
    return set_name(signatures, name, "filename")


def first_sketch(signatures: str = "signatures") -> Column:
    """The first sketch, or an empty one of the usual parameters if there is none."""
    return F.coalesce(F.get(F.col(signatures), F.lit(0)), new_sketch())


def push_sketch(sketch: Column, signatures: str = "signatures") -> Column:
    return F.array_append(F.col(signatures), sketch)


def set_sketch(sketch: Column) -> Column:
    """The list that holds this sketch alone."""
    return F.array(sketch)


def equal_signatures(a: str, b: str) -> Column:
    """Whether two signature structs agree in class, email, hash function, file, name and first sketch; licence,
    version and further sketches have no say."""
    same = [F.col(f"{a}.{f}").eqNullSafe(F.col(f"{b}.{f}")) for f in ("class", "email", "hash_function", "filename", "name")]
    return F.forall(F.array(*same, equal(first_sketch(f"{a}.signatures"), first_sketch(f"{b}.signatures"))), lambda x: x)
