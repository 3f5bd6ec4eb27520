"""DataFrame -> DataFrame operators: reports, ranking, run assembly."""
