"""Training-data operators: each module is one operator with a general interface.

Nothing outside this subpackage imports it.  ``queries.py`` registers the thin
``opN_*`` queries; ``corpus_pipeline.py`` at the repository top chains five of
the operators.
"""
