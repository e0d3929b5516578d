"""Training-data operators: deduplication, similarity joins, exact top-k,
quality and toxicity scores, tokenisation, HTML extraction and source mixing.

Each module holds one operator with its own interface; ``vetta.llm.entries``
registers one query per operator.
"""
