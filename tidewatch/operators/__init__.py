"""DataFrame operators: calendars, releases, verdicts, backtests."""
