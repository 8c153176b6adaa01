"""Plans over the test tables: fixture views, named reports, chart dispatch, query registry."""
