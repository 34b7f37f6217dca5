"""DataFrame -> DataFrame operators of the pricing study."""
