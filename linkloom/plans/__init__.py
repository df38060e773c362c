"""Named queries over the tables of a folder, with the SQL they are checked against."""
