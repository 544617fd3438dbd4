"""Spark-native processing of utterances, transcripts, vocabularies, run histories and event streams."""
