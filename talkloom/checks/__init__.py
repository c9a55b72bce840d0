"""Every operator as a query on the test tables, with the SQL that gives the same rows where SQL can."""
