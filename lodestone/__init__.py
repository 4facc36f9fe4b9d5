"""lodestone: DataFrame-native analytics for document corpora and retrieval evaluation."""
