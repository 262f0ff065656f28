"""Test-table queries. Importing this package registers all of them."""

from trailmark.plans import (  # noqa: F401
    building, comparing, regions, scoring, sources, streams, traces, vectors,
)
