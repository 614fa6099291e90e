"""Training-data operators: quality, deduplication, decontamination, secrets, tokens, scores.

Nothing outside this subpackage imports it; deleting it leaves the linear-algebra
engine whole.  Every operator takes DataFrames and returns DataFrames; each one
selects the columns it reads, so extra columns never clash.
"""
