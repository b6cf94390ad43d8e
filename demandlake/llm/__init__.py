"""Training-data operators (dedup, quality, tokens, toxicity, secrets, ...).

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its
queries when it is present."""
