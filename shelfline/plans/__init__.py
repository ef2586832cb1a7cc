"""The analytics marts (Q1-Q41) as DataFrame plans over the role views."""
