"""Operations that prepare training data for language models."""
