"""Operations on text corpora and embedding tables for training-data work.

Every operator is a function from DataFrames to a DataFrame. The thin
``opN_*`` queries that bind them to the given tables are in
:mod:`voxloom.llm.queries`.
"""
