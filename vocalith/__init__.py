"""vocalith: a Spark-native engine for speech-text corpora."""
