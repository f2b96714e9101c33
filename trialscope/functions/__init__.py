"""Column-level helpers: text, numbers, rule tables and ordered scans."""
