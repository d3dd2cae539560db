"""Training-data operators: quality rules, archives, personal data, packing, chat
tool calls, duplicate passages, language identification, near duplicates,
benchmark decontamination, token files, periodic runs, hard negatives and url filters.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
