"""Column functions: money, calendar, attribution, identity, segments, text."""
