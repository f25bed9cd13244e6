"""Operators for preparing training text.  Nothing else in the library imports this subpackage."""


def load_all():
    """The queries of this subpackage by name, with their checking SQL."""
    from codeloom.llm.queries import QUERIES

    return QUERIES
