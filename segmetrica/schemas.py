"""Column names and schemas; inputs are never inferred."""

from pyspark.sql import types as T

# Fixed column order of the canonical manifest.
MANIFEST_COLUMNS = (
    "sample_id", "relative_path", "sha256", "source_dataset",
    "source_version", "source_url", "license_id", "license_url",
    "redistribution_allowed", "derivatives_allowed", "attribution",
    "file_fake", "voice_fake", "music_fake", "voice_present",
    "music_present", "generator_family", "generator_model",
    "source_family", "speaker_id", "content_id", "codec",
    "sample_rate", "channels", "duration_seconds", "parent_sha256",
    "transformations_json",
)
LABEL_COLUMNS = ("file_fake", "voice_fake", "music_fake", "voice_present", "music_present")
PREDICTION_COLUMNS = (
    "FILE_FAKE_PROB", "VOICE_FAKE_PROB", "MUSIC_FAKE_PROB",
    "VOICE_PRESENT_PROB", "MUSIC_PRESENT_PROB",
)


def strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


MANIFEST = strings(*MANIFEST_COLUMNS)
TEMPLATE = strings("ID", *PREDICTION_COLUMNS)
LEDGER = strings("id", "date_kst", "change", "score", "ads", "cps", "status", "kept")
STREAM = "struct<segments:array<double>,silent:boolean,rms:double,n_samples:bigint>"
RECORD = (
    "seq bigint, sample_id string, audio_sha256 string, config_fingerprint string, label int, grp string, "
    f"family string, voice_present double, music_present double, voice {STREAM}, music {STREAM}, mixture {STREAM}"
)
REQUIRED_RECORD_FIELDS = (
    "sample_id", "audio_sha256", "config_fingerprint", "label", "voice_present",
    "music_present", "voice", "music", "mixture",
)
