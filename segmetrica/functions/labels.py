"""Text rules: label tokens, licences, slugs, paths, group keys."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed token lists.
REAL_TOKENS = ("real", "bonafide", "genuine", "0")
FAKE_TOKENS = ("fake", "spoof", "synthetic", "1")
TRAIN_REAL_TOKENS = ("real", "bonafide", "bona-fide", "bona_fide", "0")
TRAIN_FAKE_TOKENS = ("fake", "spoof", "1")
# How licence URLs and titles (in lower case) are read. Equal results need equal patterns.
CC_URL = r"/licenses/(by[a-z-]*)/(\d+\.\d+)(?:/([a-z]{2}))?"
NO_DERIVATIVES_URL = r"/by(?:-nc)?-nd(?:[/-]|$)"
NO_DERIVATIVES_TITLE = r"no[\s-]*deriv"
NON_COMMERCIAL_URL = "/by-nc"
NON_COMMERCIAL_TITLE = "noncommercial"  # in the title without spaces and hyphens
PUBLIC_DOMAIN = (  # identifier, part of the URL, pattern of the title
    ("CC0-1.0", "publicdomain/zero", "cc0"),
    ("CC-PDM-1.0", "publicdomain/mark", "public domain mark"),
    ("CC-PD", "publicdomain", "^public domain$"),
)
AUDIO_EXTENSIONS = ("aac", "flac", "m4a", "mp3", "ogg", "opus", "wav", "wma")


def parse_label(text: Column, real=REAL_TOKENS, fake=FAKE_TOKENS) -> Column:
    """0, 1, or NULL for an unknown token."""
    t = F.lower(F.trim(text))
    return F.when(t.isin(*fake), 1).when(t.isin(*real), 0)


def parse_training_label(text: Column) -> Column:
    return parse_label(text, TRAIN_REAL_TOKENS, TRAIN_FAKE_TOKENS)


def known(text: Column) -> Column:
    """Trimmed text, 'unknown' where missing or blank."""
    return F.coalesce(F.nullif(F.trim(text), F.lit("")), F.lit("unknown"))


def unsafe_path(path: Column) -> Column:
    """Reason a member path is refused, NULL if it is safe."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    return (
        F.when(p.isNull() | (p == "") | p.endswith("/"), "not a file")
        .when(p.startswith("/") | p.rlike("^[A-Za-z]:"), "absolute")
        .when(p.rlike(r"(^|/)\.\.(/|$)"), "escapes its root")
    )


def content_group(track_id: Column) -> Column:
    return F.format_string("fma-%06d", track_id.cast("long"))


def member_path(track_id: Column, prefix: str = "fma_small") -> Column:
    t = track_id.cast("long")
    return F.format_string(f"{prefix}/%03d/%06d.mp3", F.floor(t / 1000), t)


NOT_ASCII = r"[^\x00-\x7F]"


@F.arrow_udf(StringType())
def _folded(text: pa.Array) -> pa.Array:
    # one text at a time: beside the batch, only its folded form is held
    fold = lambda t: None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode()
    return pa.array((fold(t.as_py()) for t in text), pa.string())


def fold_accents(text: Column) -> Column:
    """NFKD to ASCII; Spark SQL has no Unicode decomposition. Only texts with other characters go to Python."""
    other = text.rlike(NOT_ASCII)
    return F.when(other, _folded(F.when(other, text))).otherwise(text)


def slug(ascii_text: Column) -> Column:
    """Lower-case words joined by '-'; accents must be folded before."""
    return F.lower(F.regexp_replace(F.regexp_replace(ascii_text, "[^A-Za-z0-9]+", "-"), "^-+|-+$", ""))


def licence(title: Column, url: Column) -> Column:
    """Struct of licence facts; licence_id is NULL where it cannot be classified."""
    t = F.trim(F.coalesce(title, F.lit("")))
    u = F.replace(F.trim(F.coalesce(url, F.lit(""))), F.lit("http://"), F.lit("https://"))
    lt, lu = F.lower(t), F.lower(u)
    clause, version, place = (F.regexp_extract(lu, CC_URL, i) for i in (1, 2, 3))
    # by what names a licence: the public domain, else the URL's parts, else the title
    parts = F.concat_ws("-", F.lit("CC"), *[F.nullif(F.upper(x), F.lit("")) for x in (clause, version, place)])
    public = [F.when(lu.contains(part) | lt.rlike(title), name) for name, part, title in PUBLIC_DOMAIN]
    licence_id = F.coalesce(*public, F.when(version != "", parts), F.nullif(F.upper(slug(t)), F.lit("")))
    no_derivatives = lu.rlike(NO_DERIVATIVES_URL) | lt.rlike(NO_DERIVATIVES_TITLE)
    non_commercial = lu.contains(NON_COMMERCIAL_URL) | F.translate(lt, "- ", "").contains(NON_COMMERCIAL_TITLE)
    return F.struct(
        F.when(u != "", licence_id).alias("license_id"),
        u.alias("license_url"),
        F.lit(True).alias("redistribution_allowed"),
        (~no_derivatives).alias("derivatives_allowed"),
        (~non_commercial).alias("commercial_use_allowed"),
        t.alias("raw_title"),
    )
