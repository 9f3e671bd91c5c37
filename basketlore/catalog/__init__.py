"""Every operator as a named query over the standard tables, with its SQL counterpart."""
