"""Every operator applied to the supplied tables, with an equivalent SQL text where there is one."""
