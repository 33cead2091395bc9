"""Where rules, calendars and load times come from."""
