"""skein: corpus analytics for language-model training data, written for Spark."""
