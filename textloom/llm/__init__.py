"""Operations for preparing training data: scoring, archives, formatting, deduplication, filters and mixing."""
