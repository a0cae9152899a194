"""Named feature sets of the frozen scorers: clipped logits of scores and of products."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import algebra as A

# Fixed order of the thirteen component scores and their interactions.
SCORE_FIELDS = (
    "df_voice_mean", "df_music_mean", "df_music_max", "spectra", "nii",
    "artifactnet", "lofcz", "current_voice", "current_music", "voice_present",
    "music_present", "current_file", "file_music",
)
INTERACTIONS = (
    ("voice_present", "df_voice_mean"), ("voice_present", "current_voice"),
    ("music_present", "file_music"), ("music_present", "current_music"),
)
SIGNAL_FIELDS = (
    "highband_power_fraction", "rolloff95_nyquist", "spectral_flatness",
    "clipped_sample_fraction", "silent_frame_fraction",
)


def _logit_of(name: str, *factors: str):
    """Clipped logit of a column, or of a product of columns."""
    def build() -> Column:
        p = F.col(factors[0])
        for f in factors[1:]:
            p = p * F.col(f)
        return A.logit(p)

    return name, build


def _gated(name: str) -> list:
    """A probability and its product with voice presence."""
    return [_logit_of(f"logit_{name}", name), _logit_of(f"logit_vp_{name}", "voice_present", name)]


def _base() -> list:
    plain = [_logit_of(f"logit_{n}", n) for n in SCORE_FIELDS]
    return plain + [_logit_of(f"logit_{a}_x_{b}", a, b) for a, b in INTERACTIONS]


def _score_stats(scores: str, prefix: str, sort: bool = False) -> list:
    """Mean, max and range of one to three scores, the first two also gated."""
    mean = lambda: A.array_mean(F.array_sort(scores) if sort else F.col(scores))
    top = lambda: F.array_max(scores)
    vp = lambda: F.col("voice_present")
    return [
        (f"logit_{prefix}_mean", lambda: A.logit(mean())),
        (f"logit_vp_{prefix}_mean", lambda: A.logit(vp() * mean())),
        (f"logit_{prefix}_max", lambda: A.logit(top())),
        (f"logit_vp_{prefix}_max", lambda: A.logit(vp() * top())),
        (f"range_{prefix}", lambda: top() - F.array_min(scores)),
    ]


def _r10(x: Column) -> Column:
    return F.round(x, A.ROUND_PLACES)


def _support() -> list:
    voice = lambda: _r10(F.col("voice38"))
    gated_voice = lambda: _r10(_r10(F.col("voice_present")) * voice())
    gated_music = lambda: _r10(_r10(F.col("music_present")) * _r10(F.col("music17")))
    return [
        ("logit_voice38", lambda: A.logit(voice())),
        ("logit_support_voice", lambda: A.logit(gated_voice())),
        ("logit_support_music", lambda: A.logit(gated_music())),
        ("logit_support_max", lambda: A.logit(F.greatest(gated_voice(), gated_music()))),
    ]


def _consistency() -> list:
    r = lambda c: _r10(F.col(c))
    absent = lambda c, p: _r10(r(c) * (F.lit(1.0) - r(p)))
    return [
        ("logit_file29", lambda: A.logit(r("file29"))),
        ("logit_disagreement", lambda: A.logit(_r10(F.abs(r("voice38") - r("music17"))))),
        ("logit_voice_absent", lambda: A.logit(absent("voice38", "voice_present"))),
        ("logit_music_absent", lambda: A.logit(absent("music17", "music_present"))),
    ]


def _plain(name: str, source: str | None = None):
    return name, lambda: F.col(source or name).cast("double")


def _definitions(name: str) -> list:
    base = _base()
    evidence = base + _gated("eliya_fake") + _score_stats("spectra_scores", "spectra")
    stacked = evidence + [_logit_of("logit_music17", "music17")]
    support = stacked + _support()
    spectra = {n: f for n, f in _score_stats("spectra_scores", "spectra")}
    return {
        "file17": base,
        "music17": base,
        "peak19": base + _gated("df_voice_max"),
        "aux19": base + _gated("nes2_fake"),
        "signal22": base + [_plain(f) for f in SIGNAL_FIELDS],
        "evidence24": evidence,
        "music24": evidence,
        "temporal29": evidence + _score_stats("eliya_scores", "eliya", sort=True),
        "stacked25": stacked,
        "support29": support,
        "mms31": support + _gated("mms_fake"),
        "nes31": support + _gated("nes2_fake"),
        "raw31": support + [_logit_of("logit_raw_mean", "raw_df_mean"), _logit_of("logit_raw_max", "raw_df_max")],
        "consistency33": support + _consistency(),
        "margin18": base + [_plain("margin")],
        "voice8": [
            *[_logit_of(f"logit_{n}", n) for n in ("df_voice_mean", "nii", "eliya_fake")],
            ("logit_spectra_mean", spectra["logit_spectra_mean"]),
            ("logit_spectra_max", spectra["logit_spectra_max"]),
            *[_logit_of(f"logit_{n}", n) for n in ("voice_present", "voice44")],
            ("range_spectra", spectra["range_spectra"]),
        ],
    }[name]


def feature_names(name: str) -> list[str]:
    return [n for n, _ in _definitions(name)]


def feature_set(name: str) -> list[tuple[str, Column]]:
    """(name, column) pairs in the fixed order of the set; sets nest by prefix."""
    return [(n, build()) for n, build in _definitions(name)]


def complete(name: str) -> Column:
    """True where every input of the set is a valid probability."""
    ok = A.all_probabilities(*[F.col(c) for c in SCORE_FIELDS])
    arrays = lambda c: (
        F.coalesce(F.size(c).between(1, 3) & F.forall(c, A.is_probability), F.lit(False))
    )
    evidence = A.is_probability(F.col("eliya_fake")) & arrays("spectra_scores")
    p = lambda *cs: A.all_probabilities(*[F.col(c) for c in cs])
    stacked = lambda: ok & evidence & p("music17")
    support = lambda: stacked() & p("voice38")
    rules = {
        "file17": lambda: ok,
        "music17": lambda: ok,
        "peak19": lambda: ok & p("df_voice_max"),
        "aux19": lambda: ok & p("nes2_fake"),
        "signal22": lambda: ok & p(*SIGNAL_FIELDS),
        "evidence24": lambda: ok & evidence,
        "music24": lambda: ok & evidence,
        "temporal29": lambda: ok & evidence & arrays("eliya_scores"),
        "stacked25": stacked,
        "support29": support,
        "mms31": lambda: support() & p("mms_fake"),
        "nes31": lambda: support() & p("nes2_fake"),
        "raw31": lambda: support() & p("raw_df_mean", "raw_df_max")
        & (F.col("raw_df_mean") <= F.col("raw_df_max") + 1e-12),
        "consistency33": lambda: support() & p("file29"),
        "margin18": lambda: ok & A.is_number(F.col("margin").cast("double")),
        "voice8": lambda: p("df_voice_mean", "nii", "eliya_fake", "voice_present", "voice44")
        & arrays("spectra_scores")
        & (F.col("voice44") == A.incumbent_voice(F.col("df_voice_mean"), F.col("nii"), F.col("eliya_fake"), F.col("spectra_scores"))),
    }
    return rules[name]()
