"""Operations of a training-data pipeline over large text corpora."""
