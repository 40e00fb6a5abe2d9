"""Operators of a training-data pipeline: decontamination, mixing, URL filters, token counts, quality rules,
repeated-passage removal, language identification, near-duplicate groups, chat formatting, secret scans,
embedding whitening, ranked lexical search and packaged web archives."""
