"""Per-row score algebra. Everything here is a plain Column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values shared with the published scores.
EPSILON = 1e-6
SILENCE_RMS = 1e-5
NEUTRAL = 0.5
ROUND_PLACES = 10
VOICE_SPECTRA_WEIGHT = 0.625
VOICE_NII_WEIGHT = 0.20
VOICE_ELIYA_WEIGHT = 0.25
MUSIC_ARTIFACT_WEIGHT = 0.25
FILE_MUSIC_ARTIFACT_WEIGHT = 0.50
MUSIC_LOFCZ_WEIGHT = 0.75
MUSIC_LOFCZ_FINAL_WEIGHT = 0.96875
SEGMENT_BLEND_WEIGHT = 0.5
TUNED_WEIGHTS = {"file": 0.15, "voice": 0.10, "music": 0.35}
WINDOW_HEAD_COEF = (0.24235476163554562, 0.20492590790397378, 0.1729559943355824, 0.5537457813724879)
WINDOW_HEAD_INTERCEPT = -0.2735022303019513
TUNED_POOLING = {  # head -> (tau, gamma, a, b)
    "file": (4.0, 0.0, 0.42680907029203735, -0.6304034896286665),
    "voice": (4.0, 0.0, 0.5648970026469469, -1.2910782155102363),
    "music": (1000.0, 2.0, 0.3936595595390725, -0.13954637928984984),
}


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def is_number(x: Column) -> Column:
    """Not NULL, not NaN, finite. Never NULL itself."""
    return F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))


def is_probability(x: Column) -> Column:
    """Finite and inside [0, 1]. Never NULL itself."""
    return F.coalesce(~F.isnan(x) & (x >= 0.0) & (x <= 1.0), F.lit(False))


def all_probabilities(*cols: Column) -> Column:
    out = F.lit(True)
    for c in cols:
        out = out & is_probability(c)
    return out


def clip(x: Column, low: float, high: float) -> Column:
    """Clip that keeps NULL: greatest/least alone would turn NULL into a bound."""
    return F.when(x.isNotNull() & ~F.isnan(x), F.greatest(F.least(x, F.lit(high)), F.lit(low)))


def logit(p: Column, eps: float = EPSILON) -> Column:
    q = clip(p, eps, 1.0 - eps)
    return F.log(q) - F.log1p(-q)


def ratio_logit(p: Column, eps: float = EPSILON) -> Column:
    """The other published form, log(p / (1 - p)); the last bits differ from logit."""
    q = clip(p, eps, 1.0 - eps)
    return F.log(q / (F.lit(1.0) - q))


def sigmoid(z: Column) -> Column:
    return F.when(z >= 0, F.lit(1.0) / (F.lit(1.0) + F.exp(-z))).when(
        z < 0, F.exp(z) / (F.lit(1.0) + F.exp(z))
    )


def linear_blend(current: Column, new: Column, w) -> Column:
    return (F.lit(1.0) - _c(w)) * current + _c(w) * new


def logit_blend(current: Column, new: Column, w) -> Column:
    return sigmoid((F.lit(1.0) - _c(w)) * ratio_logit(current) + _c(w) * ratio_logit(new))


def gate(score: Column, presence: Column, exponent) -> Column:
    """presence^exponent * score; exponent 0 switches the gate off."""
    p = clip(presence, 0.0, 1.0)
    if isinstance(exponent, Column):
        return F.when(exponent == 0.0, score).when(exponent == 1.0, p * score).otherwise(
            F.pow(p, exponent) * score
        )
    if exponent < 0:
        raise ValueError("presence exponent must not be negative")
    if exponent == 0:
        return score
    return p * score if exponent == 1 else F.pow(p, F.lit(float(exponent))) * score


COMBINE_MODES = ("max", "prob_or", "sum_clipped", "mean")


def combine(voice: Column, music: Column, mode) -> Column:
    """Join two component scores; NULL in, NULL out."""
    both = voice.isNotNull() & music.isNotNull()
    forms = {
        "max": F.greatest(voice, music),
        "prob_or": F.lit(1.0) - (F.lit(1.0) - voice) * (F.lit(1.0) - music),
        "sum_clipped": F.least(F.lit(1.0), voice + music),
        "mean": (voice + music) * 0.5,
    }
    if isinstance(mode, str):
        return F.when(both, forms[mode])
    picked = F.when(mode == "max", forms["max"])
    for name in COMBINE_MODES[1:]:
        picked = picked.when(mode == name, forms[name])
    return F.when(both, picked)


def component_max(voice: Column, music: Column, vp: Column, mp: Column) -> Column:
    return combine(vp * voice, mp * music, "max")


def component_floor(file: Column, voice: Column, music: Column, vp: Column, mp: Column) -> Column:
    """Raise FILE to its gated components; one invalid input keeps FILE as it is."""
    ok = all_probabilities(file, voice, music, vp, mp)
    return F.when(ok, F.round(F.greatest(file, vp * voice, mp * music), ROUND_PLACES)).otherwise(file)


def retain(candidate: Column, previous: Column, complete: Column | None = None) -> Column:
    """Take a candidate only if it is complete and valid, else the whole previous value."""
    ok = is_probability(candidate)
    if complete is not None:
        ok = ok & F.coalesce(complete, F.lit(False))
    return F.when(ok, candidate).otherwise(previous)


def reversed_logit_to_fake(z: Column) -> Column:
    """Detector logit where higher means genuine."""
    return sigmoid(-z)


def two_class_softmax(logits: Column, index: int) -> Column:
    """softmax(logits)[index] of a two-element array."""
    other = 1 - index
    return sigmoid(F.element_at(logits, index + 1) - F.element_at(logits, other + 1))


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(
        F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v
    )


def margin_squash(z: Column) -> Column:
    """Unsaturated map of a margin to (0, 1)."""
    return F.lit(0.5) + F.atan(z) / F.lit(3.141592653589793)


def nullable_label(text: Column) -> Column:
    """'', nan, None -> NULL, else the integer part of the number."""
    t = F.trim(text)
    return F.when(~t.isin("", "nan", "None"), F.expr("1") * t.try_cast("double").cast("int"))


def incumbent_voice(df_mean: Column, nii: Column, eliya: Column, spectra_scores: Column) -> Column:
    """Published VOICE blend: linear with the crop mean, logit with the second model, linear again."""
    blended = linear_blend(df_mean, array_mean(spectra_scores), VOICE_SPECTRA_WEIGHT)
    return linear_blend(logit_blend(blended, nii, VOICE_NII_WEIGHT), eliya, VOICE_ELIYA_WEIGHT)


def window_head_logit(df: Column, spectra: Column, nii: Column, eliya: Column) -> Column:
    z = F.lit(WINDOW_HEAD_INTERCEPT)
    for coef, value in zip(WINDOW_HEAD_COEF, (df, spectra, nii, eliya)):
        z = z + F.lit(coef) * ratio_logit(value)
    return z


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double"))


def array_mean(a: Column) -> Column:
    return F.when(F.size(a) > 0, array_sum(a) / F.size(a))
