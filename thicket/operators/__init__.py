"""Trees, boosters and what is made from them."""
