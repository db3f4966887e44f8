"""Speech plans and the views over them."""
