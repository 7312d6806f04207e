"""The queries of the library, by name, with their SQL."""

from tremorlake.plans import catalog, curation, maintenance, series, streams  # noqa: F401  (the others add to the queries of the first)
