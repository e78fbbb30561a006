"""DataFrame operators for analysing machine fault logs at fleet scale."""
