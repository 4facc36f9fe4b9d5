"""Training-data operators: language ID, URL rules, chat formatting, LM scoring,
decontamination, token files, top-k search, BPE, near-dedup and substring dedup.

Nothing else in the library imports this subpackage.
"""
