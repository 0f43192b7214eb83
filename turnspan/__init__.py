"""turnspan: a PySpark-native engine for speaker-segmented audio and labelled intervals."""

from turnspan.plans.diarizer import AudioFormatError, Diarization, Diarizer, save_json, save_rttm, speaker_similarity

__version__ = "0.1.0"
__all__ = ["AudioFormatError", "Diarization", "Diarizer", "save_json", "save_rttm", "speaker_similarity"]
