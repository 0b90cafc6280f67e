"""plyworks: a Spark-native engine for board-game self-play corpora."""
