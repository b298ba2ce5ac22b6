"""Operators that prepare training corpora: sharding, mixing, archives, privacy, language, search, scoring,
tokenizing and near-duplicate detection. Nothing outside this subpackage imports it."""
