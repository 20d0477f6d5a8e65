"""Named queries: operators bound to tables, with the equivalent SQL where there is one."""
