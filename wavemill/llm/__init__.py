"""Training-data operators: packing, search, language ID, near-duplicates,
language-model scoring, personal data, page text, mixing, URL filters, source
divergence, benchmark decontamination and ranked search.

Nothing outside this subpackage imports it; ``__spark_entry__`` registers its
queries only when it is present.
"""
