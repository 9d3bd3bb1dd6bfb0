"""Column functions: text cleaning, token bags, similarities."""
