"""Row-local operators on structured streams."""
