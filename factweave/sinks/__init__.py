"""Writers of corpora, suites and reports."""
